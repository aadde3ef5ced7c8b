"""Errors by what a caller can do about them."""


class LodestackError(Exception):
    """Anything this library raises on purpose."""


class ConfigError(LodestackError, ValueError):
    """A setting, board description or name that cannot work."""


class SelectorError(ConfigError):
    """A selector that is not of the form css::extraction, or outside the supported grammar."""


class FetchError(LodestackError):
    """A page could not be read."""


class RobotsDenied(FetchError):
    """robots.txt forbids the page."""


class CircuitOpen(FetchError):
    """The host failed too often and is left alone for a while."""


class AdapterError(LodestackError):
    """A source's own parser failed."""


class SnapshotTooLarge(LodestackError):
    """A page body beyond the archive's limit."""


class Unavailable(LodestackError):
    """A service answered with an error status."""


#: Names in the error column of result tables.
ERROR_CLASSES = {c.__name__: c for c in (ConfigError, SelectorError, FetchError, RobotsDenied, CircuitOpen, AdapterError, SnapshotTooLarge, Unavailable)}
