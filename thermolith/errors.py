"""What can go wrong, under one base."""


class ThermolithError(Exception):
    pass


class ConfigurationError(ThermolithError):
    pass


class InputValidationError(ThermolithError):
    pass


class TimeAlignmentError(ThermolithError):
    pass


class ControllerError(ThermolithError):
    pass


class OptimizerError(ThermolithError):
    pass


class StorageError(ThermolithError):
    pass


class RunStateError(ThermolithError):
    pass
