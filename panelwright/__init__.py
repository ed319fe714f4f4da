"""Panel preparation, forecasting and evaluation as lazy Spark DataFrame transformations."""

from panelwright.spec import PanelSpec, detect_time_column

__all__ = ["PanelSpec", "detect_time_column"]
