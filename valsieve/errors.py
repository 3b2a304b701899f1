"""One exception type per job; all are ``ValueError`` subclasses."""


class IntegrityError(ValueError):
    """A run, journal or control table is not fit to be recorded."""


class UniverseError(ValueError):
    """The version registry or one of its universes breaks a rule."""


class DiscoveryError(ValueError):
    """A discovery profile or snapshot lacks coverage or coherence."""


class SelectionError(ValueError):
    """A snapshot, profile or selection breaks the selection rules."""


class RefinementError(ValueError):
    """The observation or the refill of a universe is not reliable."""


class VerificationError(ValueError):
    """The verification input or its history is not coherent."""
