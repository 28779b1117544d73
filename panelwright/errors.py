"""Failures of the library; a broken contract raises and is never coerced."""


class PanelwrightError(Exception):
    pass


class ConfigurationError(PanelwrightError):
    pass


class DataContractError(PanelwrightError):
    """The data does not have the shape that the operator states."""


class MethodContractError(PanelwrightError):
    """The arguments do not make sense together."""


class ReportError(PanelwrightError):
    pass


class PluginError(PanelwrightError):
    pass
