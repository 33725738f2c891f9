"""Names, patterns and grids that have to be exactly these for right results."""

# Words that mark a business as being in scope.
CATEGORY_TERMS = ("Restaurants", "Food", "Bars")

# Text attributes that become 0/1 flags by comparison with 'True'.
SIMPLE_FLAGS = (
    "attributes_AcceptsInsurance",
    "attributes_BYOB",
    "attributes_BikeParking",
    "attributes_BusinessAcceptsBitcoin",
    "attributes_BusinessAcceptsCreditCards",
    "attributes_ByAppointmentOnly",
    "attributes_Caters",
    "attributes_CoatCheck",
    "attributes_Corkage",
    "attributes_DogsAllowed",
    "attributes_DriveThru",
    "attributes_GoodForDancing",
    "attributes_GoodForKids",
    "attributes_HappyHour",
    "attributes_HasTV",
    "attributes_Open24Hours",
    "attributes_OutdoorSeating",
    "attributes_RestaurantsCounterService",
    "attributes_RestaurantsDelivery",
    "attributes_RestaurantsGoodForGroups",
    "attributes_RestaurantsReservations",
    "attributes_RestaurantsTableService",
    "attributes_RestaurantsTakeOut",
    "attributes_WheelchairAccessible",
)

# Output flag, source attribute, terms of which any one sets the flag.
SPECIAL_FLAGS = (
    ("doesnt_serve_alcohol", "attributes_Alcohol", ("none",)),
    ("has_ambience", "attributes_Ambience", ("True",)),
    ("has_specific_bestnight", "attributes_BestNights", ("True",)),
    ("has_music", "attributes_Music", ("True",)),
    ("has_parking", "attributes_BusinessParking", ("True",)),
    ("has_specific_goodmeal", "attributes_GoodForMeal", ("True",)),
    ("has_age_restrict", "attributes_AgesAllowed", ("plus",)),
    ("has_diet_option", "attributes_DietaryRestrictions", ("True",)),
    ("allows_smoking", "attributes_Smoking", ("yes", "outdoor")),
    ("has_wifi", "attributes_WiFi", ("paid", "free")),
)

# The price attribute, the text that stands for missing, and its default.
PRICE = "attributes_RestaurantsPriceRange2"
PRICE_MISSING_TEXT = "None"
PRICE_DEFAULT = 2.5

# Attributes that are kept but feed no flag.
UNUSED_ATTRIBUTES = (
    "attributes_BYOBCorkage",
    "attributes_NoiseLevel",
    "attributes_RestaurantsAttire",
)

# Business columns that pass through unchanged; the first one is the key.
BASE_COLUMNS = ("business_id", "city", "is_open", "review_count", "stars", "state")

# Columns that tell closed businesses and delivery.
CLOSED = "Temporary Closed Until"
DELIVERY = "delivery or takeout"

# Texts for an open business and for the positive class.
OPEN_TEXT = "FALSE"
POSITIVE_TEXT = "TRUE"

# Fixed value: the day recency and tenure are measured to.
REFERENCE_DAY = "2020-04-01"

# Share, seed and number of folds of the stratified split and the grid search.
TRAIN_SHARE = 0.7
SPLIT_SEED = 42
FOLDS = 10

# Full hyper-parameter grids.
LOGISTIC_GRID = {"regParam": [0.1, 0.01], "maxIter": [50, 100, 150]}
TREE_GRID = {"maxDepth": [2, 5, 10, 20, 30], "maxBins": [10, 20, 40, 80, 100]}
FOREST_GRID = {
    "numTrees": [100, 200, 300],
    "impurity": ["gini", "entropy"],
    "maxDepth": [4, 8, 12],
}
