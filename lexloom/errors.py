"""Errors that the library raises."""


class LexloomError(Exception):
    """Base of all."""


class FilterError(LexloomError):
    """A filter that is malformed or compares what can't be compared."""


class DuplicateDocument(LexloomError):
    """A written id is already stored."""


class MissingDocument(LexloomError):
    """A document that an operator needs isn't there."""


class PipelineError(LexloomError):
    """A graph that can't be built or run."""


class MaxRunsError(PipelineError):
    """A loop ran more often than allowed."""


class ModelUnavailable(LexloomError):
    """A model or optional package is missing."""
