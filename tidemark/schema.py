"""Table layouts shared by sources and operators.

Panels are long: one row per (model, vintage, series_id, period).  A missing
observation is NULL, never NaN, because Spark aggregates skip NULL but
propagate NaN.
"""

CELL = ["model", "vintage", "series_id", "period"]
SERIES = ["model", "vintage", "series_id"]
PANEL = ["model", "vintage"]

SPEC_DDL = (
    "model string, series_id string, series_name string, frequency string, units string, "
    "transformation string, category string, blocks array<string>, spec_pos int"
)
OBS_DDL = "model string, vintage date, series_id string, period date, value double"
FACTS_DDL = "model string, series_id string, period date, release_date date, value double"
PARAMS_DDL = "model string, est_vintage date, name string, i int, j int, v double"
NOWCAST_DDL = (
    "model string, quarter string, vintage date, y_old double, y_new double, error double, "
    "abs_error double, perc_error double, impact_revisions double, impact_releases double, "
    "step_variance double, params_used string"
)
METRICS_DDL = "model string, quarter string, rmse double, mae double, bias double, mpe double"
NEWS_DDL = (
    "model string, quarter string, vintage date, series_id string, period date, "
    "forecast double, actual double, weight double, impact double"
)

# Transformation codes and their long names.
TRANSFORMATIONS = {
    "lin": "Levels (No Transformation)",
    "chg": "Change (Difference)",
    "ch1": "Year over Year Change (Difference)",
    "pch": "Percent Change",
    "pc1": "Year over Year Percent Change",
    "pca": "Percent Change (Annual Rate)",
    "cch": "Continuously Compounded Rate of Change",
    "cca": "Continuously Compounded Annual Rate of Change",
    "log": "Natural Log",
}

# Frequency codes from highest to lowest.
FREQUENCIES = ["d", "w", "m", "q", "sa", "a"]

# Weights tying a quarterly growth rate to five monthly ones.
TENT = (1.0, 2.0, 3.0, 2.0, 1.0)
