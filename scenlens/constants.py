"""Fixed values of the study: unit factors, label rules and level lists."""

# Unit factors.
EJ_TO_GJ = 1e9
THOUSAND_PERSONS = 1e3
MILLION_PERSONS = 1e6
PCAL_TO_KCAL = 1e12
DAYS_PER_YEAR = 365
MT_PER_GT = 1000
PERCENT = 100

# Reporting window and grids.
FIRST_YEAR = 2015  # exclusive in most results
LAST_YEAR = 2050
POLICY_COST_YEARS = (2025, 2050)
LEVEL_YEARS = (2015, 2030, 2050)
MAP_YEARS = (2030, 2050)
DECILES = tuple(f"d{i}" for i in range(1, 11))
DECILE_LEVELS = tuple(f"D{i}" for i in range(1, 11))
SSPS = ("SSP1", "SSP2", "SSP3", "SSP4", "SSP5")

# Sectors of final energy, matched in the raw sector text.
BUILDING_SECTORS = [
    ("has", "comm", "Commercial Buildings"),
    ("has", "resid heating", "Residential heating"),
    ("has", "resid cooling", "Residential cooling"),
    ("has", "resid other", "Residential non-thermal services"),
]
TRANSPORT_SECTORS = [
    ("has", "trn_aviation", "International Aviation (pass)"),
    ("has", "trn_pass_", "Passenger transport"),
    ("has", "trn_freight", "Freight transport"),
    ("has", "trn_shipping_intl", "International shipping (freight)"),
]
PASSENGER_SECTORS = [
    ("has", "trn_aviation", "International Aviation (pass)"),
    ("has", "trn_pass", "Passenger transport"),
]
MODERN_ENERGY_CLASSES = [
    ("has", "cooling", "Resid cooling"),
    ("has", "heating", "Resid heating"),
    ("has", "others", "Resid non-thermal"),
]
FINAL_ENERGY_LEVELS = (
    "Commercial Buildings",
    "Residential cooling",
    "Residential heating",
    "Residential non-thermal services",
    "Industry",
    "Passenger transport",
    "International Aviation (pass)",
    "Freight transport",
    "International shipping (freight)",
)
DEMAND_CLASSES = (
    "Resid cooling",
    "Resid heating",
    "Resid non-thermal",
    "Domestic transportation",
    "International aviation",
    "Non-staple food",
)
ENERGY_NEED_GJ = 16  # threshold drawn against energy per person

# Food.
STAPLES = ("Corn", "Rice", "RootTuber", "Wheat", "OtherGrain")
STAPLE_LEVELS = ("Staples", "Non-staples")
FOOD_GROUPS = [
    ("Corn", "Staple Grains"),
    ("OtherGrain", "Staple Grains"),
    ("RootTuber", "Staple Grains"),
    ("Rice", "Staple Grains"),
    ("Wheat", "Staple Grains"),
    ("Fruits", "Fruit&Veg"),
    ("Vegetables", "Fruit&Veg"),
    ("Legumes", "Plant Protein"),
    ("NutsSeeds", "Plant Protein"),
    ("FiberCrop", "Other Crops"),
    ("MiscCrop", "Other Crops"),
    ("OilCrop", "Oil Crops"),
    ("OilPalm", "Oil Crops"),
    ("Soybean", "Oil Crops"),
    ("SugarCrop", "Oil Crops"),
    ("OtherMeat_Fish", "Animal Protein"),
    ("Beef", "Animal Protein"),
    ("Dairy", "Animal Protein"),
    ("Pork", "Animal Protein"),
    ("Poultry", "Animal Protein"),
    ("SheepGoat", "Animal Protein"),
]
# Later rules win.
SUBSECTOR_GROUPS = [
    ("has", "Animal", "Animal protein"),
    ("has", "Plant", "Plant protein"),
    ("has", "FiberCrop", "Other crops"),
    ("has", "MiscCrop", "Other crops"),
    ("has", "OtherGrain", "Other crops"),
    ("has", "Root", "Other crops"),
    ("has", "Sugar", "Other crops"),
    ("has", "Oil", "Other crops"),
]

# Carbon market text to region name.
MARKET_REGIONS = [
    ("CAC", "Central America and Caribbean"),
    ("Central_Asia", "Central Asia"),
    ("EFTA", "European Free Trade Association"),
    ("EU-12", "EU_12"),
    ("EU-15", "EU_15"),
    ("Middle_East", "Middle East"),
    ("SAN", "South America_Northern"),
    ("SAS", "South America_Southern"),
    ("South_Africa", "South Africa"),
    ("South_Asia", "South Asia"),
    ("South_Korea", "South Korea"),
    ("Southeast_Asia", "Southeast Asia"),
]

# Warming potentials per gas; CO2 also converts carbon to CO2.
GWP = [
    ("CH4", 28.0),
    ("N2O", 265.0),
    ("C2F6", 11.1),
    ("CF4", 6.63),
    ("HFC125", 3.17),
    ("HFC134a", 1.3),
    ("HFC245fa", 0.858),
    ("SF6", 23.5),
    ("CO2", 3.666666667),
    ("CO2LUC", 3.666666667),
    ("CH4_AGR", 28.0),
    ("N2O_AGR", 265.0),
    ("CH4_AWB", 28.0),
    ("N2O_AWB", 265.0),
]
GAS_GROUPS = [
    ("is", "CO2LUC", "CO2_LUC"),
    ("is", "CO2", "CO2"),
    ("has", "CH4", "CH4"),
]
POLLUTANTS = ("BC", "CH4", "CO", "N2O", "NH3", "NMVOC", "NOx", "OC", "SO2")

# Model regions and the coarser regions they report into.
REGIONS = [
    (1, "USA", "USA"),
    (2, "Africa_Eastern", "Africa"),
    (3, "Africa_Northern", "Africa"),
    (4, "Africa_Southern", "Africa"),
    (5, "Africa_Western", "Africa"),
    (6, "Australia_NZ", "Australia_NZ"),
    (7, "Brazil", "Brazil"),
    (8, "Canada", "Canada"),
    (9, "Central America and Caribbean", "Central America"),
    (10, "Central Asia", "Central Asia"),
    (11, "China", "China"),
    (12, "EU-12", "Europe"),
    (13, "EU-15", "Europe"),
    (14, "Europe_Eastern", "Europe"),
    (15, "Europe_Non_EU", "Europe"),
    (16, "European Free Trade Association", "Europe"),
    (17, "India", "India"),
    (18, "Indonesia", "Indonesia"),
    (19, "Japan", "Japan"),
    (20, "Mexico", "Central America"),
    (21, "Middle East", "Middle East"),
    (22, "Pakistan", "South Asia"),
    (23, "Russia", "Russia"),
    (24, "South Africa", "Africa"),
    (25, "South America_Northern", "Rest of South America"),
    (26, "South America_Southern", "Rest of South America"),
    (27, "South Asia", "South Asia"),
    (28, "South Korea", "South Korea"),
    (29, "Southeast Asia", "Southeast Asia"),
    (30, "Taiwan", "Southeast Asia"),
    (31, "Argentina", "Rest of South America"),
    (32, "Colombia", "Rest of South America"),
]
SHARE_REGIONS = (
    "Africa_Southern", "Brazil", "Australia_NZ", "Canada", "China", "EU-15",
    "India", "Japan", "Middle East", "Russia", "South Africa", "USA",
)
FIT_REGIONS = (
    "Africa_Eastern", "Brazil", "China", "EU-15", "India", "Japan",
    "Russia", "South Asia", "USA",
)

# Income-distribution models and their sensitivity names.
REFERENCE_MODEL = "PCA algorithm (Two Components)"
SENSITIVITY_MODELS = [
    ("PCA algorithm (Two Components)", "SA_PCA"),
    ("Lognormal functional form", "SA_LogNorm"),
]

# Known solver artefacts, overwritten in the final tables.
FOOD_PATCHES = [({"subRegion": "Central Asia", "year": 2050, "demand": "NonStaples"}, 0)]
POLICY_COST_PATCHES = [
    ({"region": "European Free Trade Association"}, 0),
    ({"region": "Africa_Eastern"}, 0.01),
]
COMPLIANCE_EXCLUDED = ("European Free Trade Association",)

# Class breaks of the income map.
INCOME_BREAKS = (1, 2.17, 10, 30, 50, 70, 100, 500, 1000)
