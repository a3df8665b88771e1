"""Errors that a user can act on."""


class CurationError(Exception):
    """Base of all expected errors."""


class InvalidSource(CurationError):
    """The source's address isn't one that is understood."""


class SourceUnavailable(CurationError):
    """The source exists but can't be had."""


class FetchFailed(CurationError):
    """The source couldn't be fetched for another reason."""


class MissingTool(CurationError):
    """A program that is needed isn't installed."""


class NothingDetected(CurationError):
    """No detection is left to work on."""


class NoTarget(CurationError):
    """No cluster can be chosen as the target."""


class ComponentTooLarge(CurationError):
    """A component is larger than the limit that was set."""
