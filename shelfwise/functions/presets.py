"""Lookup tables of the original daily file (fixed values).

These are the values a user of the original application needs to run the operators on
its own daily file: which quantity columns make up each dish, the course type of each
item, the holiday dates, the item groups and the fixed serving bias factors. They are
stated here as data; :func:`frames` turns them into small dimension DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: dish -> item columns (dine-in first, then takeaway) --------------
DISH_ITEMS = {
    "FOC ROSEMARY": ["FOC ROSEMARY - 7512", "TA FOC ROSE - 25600"],
    "LASAGNE": ["LASAGNE - 3513", "TA LASAGNE - 25200"],
    "PZ MARGHERITA": ["PZ MARGHERITA - 4500", "TA MARG PZ - 25300"],
    "NONNAS BURGER": ["NONNAS BURGER - 6502", "TA NONNAS BURGER - 25106"],
    "PENNE ARRABBIATA": ["PENNE ARRABBIATA - 3500", "TA PENNE ARRABBIATA - 25208"],
    "PENNE CON POLLO": ["PENNE CON POLLO - 3507", "TA PENNE POLLO - 25206"],
    "PENNE SALSICCIA": ["PENNE SALSICCIA - 3506", "TA PENNE SALSICCIA - 25204"],
    "SKINNY FRIES": ["SKINNY FRIES - 7510", "TA SKINNY FRIES - 25505"],
    "SPAG BOLGNESE": ["SPAG BOLGNESE - 3504", "TA SPAG BOLOGNESE - 25203"],
    "SPAG CARBONARA": ["SPAG CARBONARA - 3503", "TA SPAG CARBONARA - 25202"],
    "SPAG POMODORO": ["SPAG POMODORO - 3502", "TA SPAG POMODORO - 25209"],
    "BRUSHETTA CLASSICA": ["BRUSHETTA CLASSICA - 2502"],
    "MOZZARELLA FRITTA": ["MOZZARELLA FRITTA - 2003"],
    "PZ MESSICANA": ["PZ MESSICANA - 4504"],
    "RIBEYE STEAK": ["RIBEYE STEAK - 6501"],
}

# --- fixed values: course type per item ---------------------------------------------
ITEM_TYPES = {
    "BRUSHETTA CLASSICA - 2502": "Starter",
    "FOC ROSEMARY - 7512": "Starter",
    "TA FOC ROSE - 25600": "Starter",
    "MOZZARELLA FRITTA - 2003": "Starter",
    "LASAGNE - 3513": "Main",
    "TA LASAGNE - 25200": "Main",
    "NONNAS BURGER - 6502": "Main",
    "TA NONNAS BURGER - 25106": "Main",
    "PENNE ARRABBIATA - 3500": "Main",
    "TA PENNE ARRABBIATA - 25208": "Main",
    "PENNE CON POLLO - 3507": "Main",
    "TA PENNE POLLO - 25206": "Main",
    "PENNE SALSICCIA - 3506": "Main",
    "TA PENNE SALSICCIA - 25204": "Main",
    "PZ MARGHERITA - 4500": "Main",
    "TA MARG PZ - 25300": "Main",
    "PZ MESSICANA - 4504": "Main",
    "RIBEYE STEAK - 6501": "Main",
    "SPAG BOLGNESE - 3504": "Main",
    "TA SPAG BOLOGNESE - 25203": "Main",
    "SPAG CARBONARA - 3503": "Main",
    "TA SPAG CARBONARA - 25202": "Main",
    "SPAG POMODORO - 3502": "Main",
    "TA SPAG POMODORO - 25209": "Main",
    "SKINNY FRIES - 7510": "Side",
    "TA SKINNY FRIES - 25505": "Side",
}

# --- fixed values: holidays -----------------------------------------------------------
HOLIDAYS = [
    "2022-01-01", "2022-04-15", "2022-04-18", "2022-05-02", "2022-06-02",
    "2022-06-03", "2022-08-01", "2022-11-30", "2022-12-25", "2022-12-26",
    "2023-01-01", "2023-04-07", "2023-04-10", "2023-05-01", "2023-05-29",
    "2023-08-07", "2023-11-30", "2023-12-25", "2023-12-26",
]

# --- fixed values: item groups ----------------------------------------------------------
HIGH_ERROR_ITEMS = [
    "SKINNY FRIES - 7510", "TA SKINNY FRIES - 25505",
    "MOZZARELLA FRITTA - 2003", "PZ MARGHERITA - 4500",
    "TA MARG PZ - 25300", "BRUSHETTA CLASSICA - 2502",
    "PENNE SALSICCIA - 3506", "TA PENNE SALSICCIA - 25204",
    "SPAG CARBONARA - 3503", "TA SPAG CARBONARA - 25202",
]
SPECIAL_ITEMS = [
    "SPAG BOLGNESE - 3504", "TA SPAG BOLOGNESE - 25203",
    "RIBEYE STEAK - 6501", "PZ MESSICANA - 4504",
    "SPAG POMODORO - 3502",
]
LAG45_ITEMS = ["SPAG BOLGNESE - 3504", "TA SPAG BOLOGNESE - 25203"]
HIGH_DEMAND_ITEMS = [
    "SKINNY FRIES - 7510", "TA SKINNY FRIES - 25505",
    "PENNE SALSICCIA - 3506", "TA PENNE SALSICCIA - 25204",
    "PZ MARGHERITA - 4500", "TA MARG PZ - 25300",
    "PENNE CON POLLO - 3507", "TA PENNE POLLO - 25206",
]
LOW_DEMAND_WATCHED = ["RIBEYE STEAK - 6501", "SPAG BOLGNESE - 3504", "TA SPAG BOLOGNESE - 25203"]
SIDE_SATURDAY_ITEMS = ["SKINNY FRIES - 7510", "TA SKINNY FRIES - 25505"]
BOOSTING_OVERRIDE_TRAINING = HIGH_ERROR_ITEMS + SPECIAL_ITEMS
BOOSTING_OVERRIDE_SERVING = BOOSTING_OVERRIDE_TRAINING + ["TA NONNAS BURGER - 25106"]
BUFFER_OVERRIDE_A = ["RIBEYE STEAK"]
BUFFER_OVERRIDE_B = ["NONNAS BURGER"]

# --- fixed values: serving bias factors (items without one use 0.85) -------------------
SERVING_BIAS = {
    "FOC ROSEMARY - 7512": 0.85,
    "TA FOC ROSE - 25600": 0.82,
    "LASAGNE - 3513": 0.88,
    "TA LASAGNE - 25200": 0.85,
    "PZ MARGHERITA - 4500": 0.83,
    "TA MARG PZ - 25300": 0.80,
    "NONNAS BURGER - 6502": 0.87,
    "TA NONNAS BURGER - 25106": 0.84,
    "PENNE ARRABBIATA - 3500": 0.86,
    "TA PENNE ARRABBIATA - 25208": 0.83,
    "PENNE CON POLLO - 3507": 0.85,
    "TA PENNE POLLO - 25206": 0.82,
    "PENNE SALSICCIA - 3506": 0.84,
    "TA PENNE SALSICCIA - 25204": 0.81,
    "SKINNY FRIES - 7510": 0.83,
    "TA SKINNY FRIES - 25505": 0.80,
    "SPAG BOLGNESE - 3504": 0.86,
    "TA SPAG BOLOGNESE - 25203": 0.83,
    "SPAG CARBONARA - 3503": 0.85,
    "TA SPAG CARBONARA - 25202": 0.82,
    "SPAG POMODORO - 3502": 0.87,
    "TA SPAG POMODORO - 25209": 0.84,
    "BRUSHETTA CLASSICA - 2502": 0.88,
    "MOZZARELLA FRITTA - 2003": 0.86,
    "PZ MESSICANA - 4504": 0.84,
    "RIBEYE STEAK - 6501": 0.89,
}
# ------------------------------------------------------------------------------------


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The lookup tables as small dimension frames (bounded by the lists above)."""
    di = [(dish, item, "TAKEAWAY" if item.startswith("TA ") else "DINE_IN", i + 1)
          for dish, items in DISH_ITEMS.items() for i, item in enumerate(items)]
    return {
        "dish_item": spark.createDataFrame(di, "dish string, item string, channel string, ord int"),
        "item_type": spark.createDataFrame(list(ITEM_TYPES.items()), "item string, type string"),
        "holiday": spark.createDataFrame([(h,) for h in HOLIDAYS], "d string").selectExpr("to_date(d) AS date"),
        "bias": spark.createDataFrame(list(SERVING_BIAS.items()), "item string, bias_factor double"),
    }
