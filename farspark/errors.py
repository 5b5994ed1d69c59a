"""Exceptions raised by the refusal rules."""


class FoldLeakError(RuntimeError):
    """Data was asked for that the current phase may not read, or folds share time."""


class RefusedError(ValueError):
    """A result would be quoted that its inputs cannot support."""
