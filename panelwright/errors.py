"""Errors raised by guards; one class per contract that can be broken."""


class PanelError(ValueError):
    """A panel is unusable: missing columns, bad periods, duplicate keys."""


class LeakageError(ValueError):
    """Future information reached a feature matrix or an earlier split."""


class SplitError(ValueError):
    """A temporal split cannot be formed from the given periods."""


class ContractError(ValueError):
    """A data contract check failed at a publishing gate."""
