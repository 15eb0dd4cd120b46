"""Structured Streaming entry points."""

from .profile import start_profile, stream_profile  # noqa: F401
