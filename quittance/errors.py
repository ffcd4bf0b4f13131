"""What can go wrong with a run, by who has to act."""


class LedgerError(ValueError):
    """The input cannot be read as a ledger or a statement."""


class DuplicateIdError(LedgerError):
    """An id stands more than once on its side."""


class InvariantViolation(RuntimeError):
    """A result breaks a law of money; nothing of it may be used."""
