"""Parameters of the registered queries over the driver's tables (FIXTURES.md).

Item groups and cut-offs are operator arguments; these are the values used on the
test tables, chosen so that every branch of the ladders is reached.
"""

TRAIN_YEAR = 1999
TEST_YEAR = 2000
BASE_YEAR = 1999
AS_OF = "2000-06-15"
HOLIDAY_MONTH_DAYS = [(1, 1), (12, 25), (12, 26)]   # Jan 1, Dec 25, Dec 26 of every year
OVERRIDE_A = ["Brand#1"]     # fixed small buffer
OVERRIDE_B = ["Brand#2"]     # fixed buffer
BRANDS = [f"Brand#{n}" for n in range(1, 26)]
CHANNELS = ["O", "F"]        # l_linestatus: O = dine-in, F = takeaway
ITEMS = [f"{b} {c}" for b in BRANDS for c in CHANNELS]

HIGH_DEMAND = [f"Brand#{n} {c}" for n in range(1, 5) for c in CHANNELS]            # 8 items
HIGH_ERROR = [f"Brand#{n} {c}" for n in range(5, 10) for c in CHANNELS]            # 10 items
LAG45 = ["Brand#10 O", "Brand#10 F"]                                               # lags 4, 5
SPECIAL = LAG45 + ["Brand#11 O", "Brand#12 O", "Brand#13 O"]
HARD = HIGH_ERROR + SPECIAL                                                       # lags 2, 3
WATCHED = ["Brand#11 O", "Brand#10 O", "Brand#10 F"]                               # low demand
LAG_GROUPS = {1: None, 2: HARD, 3: HARD, 4: LAG45, 5: LAG45}

# cut-offs on the test tables (item means lie between about 7.8 and 15.2)
STABLE_MAX_AVG, STABLE_MAX_STD = 12.0, 20.0
RMSE_BUFFER_HIGH = 12.0
SHARE_BUFFER_HIGH, SHARE_BUFFER_MID = 13.0, 11.5
SITE_BUFFER_HIGH, SITE_BUFFER_MID = 2.4, 2.1   # item means per site: about a fifth
HIGH_WASTE = 0.15
NEAR_EXPIRY_DAYS = 2
