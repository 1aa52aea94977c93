"""Fixed values of the reports.

These must equal the values the source reports use, so they are stated here
once, in natural order, and imported wherever they are needed (plans,
operators, schemas and the SQL oracle). They become keyword defaults of the
report functions, so a caller can pass other values.
"""

# --- Fixed values -------------------------------------------------------------------

# Business lines whose stock is sellable and whose sales count in the metrics.
BUSINESS_LINES = ("P07", "P08", "P12")

# Sellable sub-inventories: codes starting with this prefix, plus these codes.
SUBINVENTORY_PREFIX = "80"
SUBINVENTORY_EXTRA = ("8206", "8210")

# Documented sales metrics: rows of this (data flag, channel) pair are excluded,
# and only this reason code counts.
EXCLUDED_FLAG_CHANNEL = ("Primary Sales", "Distributor - A")
SALES_REASON = "Sales"

# Target cover days per item class.
THRESHOLD_DAYS = {"A": 30, "B": 20, "C": 15}

# Cover days at or above this value are not "above threshold" in the service measure.
COVER_CEILING = 9999

# Inventory values with a magnitude below this count as zero in cover days.
SNAP_EPSILON = 0.001

# Branch columns of the item x branch cover report, in output order
# (branch code -> column); the service measure lists the same 14 branches.
BRANCH_COLUMNS = {
    "8006": "bahawalpur", "8018": "dss_korangi", "8019": "faisalabad", "8023": "gujranwala",
    "8028": "hyderabad", "8029": "islamabad", "8035": "karachi", "8044": "korangi",
    "8046": "lahore", "8056": "mingora", "8059": "multan", "8070": "peshawar",
    "8072": "quetta", "8085": "sukkur",
}

# Labels for missing values.
OTHERS = "Others"          # missing item class
UNKNOWN = "Unknown"        # missing item description
NOT_AVAILABLE = "NA"       # missing storage location name
TOTAL = "Total"            # label of a total row
SELL_SUFFIX = " SELL"      # removed from location descriptions in the service measure

# Value buckets of the valuation snapshot, in output order: (input, output).
VALUE_BUCKETS = [
    ("valuatedgrblocked", "gr_blocked_val"),
    ("valueunrestricted", "unrestricted_val"),
    ("valuequalityinspection", "quality_inspection_val"),
    ("valuereturns", "returns_val"),
    ("valuestktransferstloc", "storage_location_val"),
    ("valuestocktransferplant", "stock_transfer_plant_val"),
    ("valuestockintransit", "stock_in_transit_val"),
    ("valueblocked", "blocked_val"),
    ("valuerestricted", "restricted_val"),
    ("valuetiedempties", "tied_empties_val"),
]

# Quantity buckets, in output order: (input, output, counted in total_qty).
QTY_BUCKETS = [
    ("unrestricted", "unrestricted_qty", True),
    ("qualityinspection", "qualityinspection_qty", True),
    ("returns", "return_qty", True),
    ("stocktransferstoragelocation", "stocktransferstoragelocation_qty", True),
    ("stocktransferplant", "stocktransferplant_qty", True),
    ("stockintransit", "stockintransit_qty", False),
    ("blocked", "blocked_qty", True),
    ("restricted", "restricted_qty", True),
    ("tiedempties", "tiedempties_qty", True),
]

# Grouping keys of the valuation and WIP reports.
VALUATION_KEYS = ["materialname", "producttype", "plant", "storagelocation",
                  "storagelocationname", "plantname"]
WIP_KEYS = ["storage_loc", "storage_loc_desc", "plant", "plnt_desc", "material_type_description",
            "type_description", "order_number", "item_qty", "good_received_qty"]
