"""Fixed values that results depend on.

These are stated plainly because results must agree with the original daily-file
conventions: column prefixes of the wide file, weekday one-hot column order, default
prices, cost share, shelf life and the learner settings. Ladder cut-offs are defaults
of operator arguments, not hidden constants.
"""

# --- fixed values: wide daily file conventions ---------------------------------
DATE_COL = "Date"
QTY_PREFIX = "Qty (Sales)_"
REV_PREFIX = "Gross Rev._"
WEEKDAY_PREFIX = "Day of the Week_"
# One-hot weekday columns in the order they are tested (first equal to 1 wins).
WEEKDAY_ONEHOT_ORDER = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
UNKNOWN_WEEKDAY = "Unknown"
# Report order of weekdays.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND = ["Saturday", "Sunday"]
# Weather columns of the wide file and their short names in the long model.
WEATHER_COLUMNS = {
    "Temp Avg (°C)": "temp_avg",
    "Precipitation (mm)": "precipitation",
    "Windspeed (km/h)": "windspeed",
    "Humidity (%)": "humidity",
}

# --- fixed values: stock and money ---------------------------------------------
SHELF_DAYS = 3            # a lot received on day d is sellable d..d+3, waste on d+4
COST_RATE = 0.25          # cost of sales as a share of price
DEFAULT_PRICE = 10.0      # price when a dish never sold
DEFAULT_BIAS = 0.85       # bias factor for items without a fitted factor
BLEND_WEIGHTS = (0.6, 0.4)  # forest, boosting

# --- fixed values: learners ------------------------------------------------------
FOREST = dict(numTrees=150, maxDepth=8, minInstancesPerNode=3, seed=42, maxBins=64)
# engine settings, not model settings: cached node ids; the split-statistics memory per
# task is sized from the heap (see shelfwise.operators.forecast.forest_engine)
FOREST_ENGINE = dict(cacheNodeIds=True)
BOOSTING = dict(maxIter=120, maxDepth=4, stepSize=0.03, subsamplingRate=0.8, maxBins=64,
                featureSubsetStrategy="0.8", seed=42)
