"""Fixed values that must equal the place pipeline's for identical results.

Everything in this module is a fixed value (lookup tables, feature lists,
weights, phrase pairs, thresholds), stated plainly in natural order.
"""

from placescore.operators.score import Feature

# ---------------------------------------------------------------- fixed values: U.S. state names -> postal codes
STATE_TO_CODE = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA",
    "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO",
    "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH",
    "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT",
    "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
    "DISTRICT OF COLUMBIA": "DC", "PUERTO RICO": "PR",
}

# ---------------------------------------------------------------- fixed values: two-digit state FIPS -> state name
STATE_FIPS = {
    "01": "Alabama", "02": "Alaska", "04": "Arizona", "05": "Arkansas", "06": "California",
    "08": "Colorado", "09": "Connecticut", "10": "Delaware", "11": "District of Columbia", "12": "Florida",
    "13": "Georgia", "15": "Hawaii", "16": "Idaho", "17": "Illinois", "18": "Indiana",
    "19": "Iowa", "20": "Kansas", "21": "Kentucky", "22": "Louisiana", "23": "Maine",
    "24": "Maryland", "25": "Massachusetts", "26": "Michigan", "27": "Minnesota", "28": "Mississippi",
    "29": "Missouri", "30": "Montana", "31": "Nebraska", "32": "Nevada", "33": "New Hampshire",
    "34": "New Jersey", "35": "New Mexico", "36": "New York", "37": "North Carolina", "38": "North Dakota",
    "39": "Ohio", "40": "Oklahoma", "41": "Oregon", "42": "Pennsylvania", "44": "Rhode Island",
    "45": "South Carolina", "46": "South Dakota", "47": "Tennessee", "48": "Texas", "49": "Utah",
    "50": "Vermont", "51": "Virginia", "53": "Washington", "54": "West Virginia", "55": "Wisconsin",
    "56": "Wyoming", "72": "Puerto Rico",
}

# ---------------------------------------------------------------- fixed values: place scoring
# (feature, transform, inverted); the temperature distance is |avg_annual_temp - 65|.
PLACE_FEATURES = [
    Feature("MedianHomeValue_B25077", "log1p", True),
    Feature("MedianGrossRent_B25064", "log1p", True),
    Feature("MedianHouseholdIncome_B19013", None, False),
    Feature("job_growth", "asinh", False),
    Feature("population_growth", "asinh", False),
    Feature("unemployment_rate", "log1p", True),
    Feature("violent_crime_per_population", "log1p", True),
    Feature("property_crime_per_population", "log1p", True),
    Feature("bachelors_or_higher_share", None, False),
    Feature("obesity_share", None, True),
    Feature("physical_inactivity_share", None, True),
    Feature("depression_share", None, True),
    Feature("current_asthma_share", None, True),
    Feature("diabetes_share", None, True),
    Feature("stroke_share", None, True),
    Feature("coronary_heart_disease_share", None, True),
    Feature("arthritis_share", None, True),
    Feature("any_disability_share", None, True),
    Feature("current_smoking_share", None, True),
    Feature("nat_walk_index_pop_weighted", None, False),
    Feature("diversity_index", None, False),
    Feature("population_density_per_sq_mile", "log1p", False),
    Feature("intersection_density_mean", "log1p", False),
    Feature("activity_density_mean", "log1p", False),
    Feature("avg_annual_temp", None, False),
    Feature("temp_seasonality", None, True),
    Feature("annual_snowfall", "log1p", True),
    Feature("annual_precipitation", None, True),
    Feature("_temp_distance", None, True, source="avg_annual_temp", target=65.0),
]

PLACE_DIMENSIONS = {
    "affordability_score": {"MedianHomeValue_B25077": 1 / 3, "MedianGrossRent_B25064": 1 / 3,
                            "MedianHouseholdIncome_B19013": 1 / 3},
    "job_growth_score": {"job_growth": 0.50, "population_growth": 0.20, "unemployment_rate": 0.30},
    "safety_score": {"violent_crime_per_population": 0.50, "property_crime_per_population": 0.50},
    "education_score": {"bachelors_or_higher_share": 1.0},
    "health_score": {"obesity_share": 0.10, "physical_inactivity_share": 0.10, "depression_share": 0.10,
                     "current_asthma_share": 0.08, "diabetes_share": 0.12, "stroke_share": 0.10,
                     "coronary_heart_disease_share": 0.12, "arthritis_share": 0.08,
                     "any_disability_share": 0.10, "current_smoking_share": 0.10},
    "walkability_score": {"nat_walk_index_pop_weighted": 1.0},
    "diversity_score": {"diversity_index": 1.0},
    "urban_score": {"population_density_per_sq_mile": 0.50, "intersection_density_mean": 0.25,
                    "activity_density_mean": 0.25},
    "weather_warmth_score": {"avg_annual_temp": 1.0},
    "weather_mildness_score": {"_temp_distance": 0.40, "temp_seasonality": 0.30, "annual_snowfall": 0.20,
                               "annual_precipitation": 0.10},
}
PLACE_DIMENSION_COLS = list(PLACE_DIMENSIONS)
PLACE_ID_COLS = ["cbsa_code", "cbsa_name", "city", "state", "cbsa_type"]

# ---------------------------------------------------------------- fixed values: cluster naming
# feature -> (phrase when above the median, phrase when below); the last four pairs
# read against their values (O2): names that must match published ones need them so
NAME_PHRASES = {
    "MedianHouseholdIncome_B19013": ("Higher-income", "Lower-income"),
    "MedianHomeValue_B25077": ("Expensive housing", "Affordable housing"),
    "MedianGrossRent_B25064": ("High-rent", "Low-rent"),
    "bachelors_or_higher_share": ("More educated", "Less educated"),
    "nat_walk_index_pop_weighted": ("More walkable", "Car-dependent"),
    "population_density_per_sq_mile": ("Denser", "More spread out"),
    "diversity_index": ("More diverse", "Less diverse"),
    "job_growth": ("Fast job growth", "Weak job growth"),
    "population_growth": ("Fast population growth", "Weak population growth"),
    "avg_annual_temp": ("Warmer", "Cooler"),
    "annual_snowfall": ("Snowier", "Less snowy"),
    "unemployment_rate": ("Lower unemployment", "Higher unemployment"),
    "poverty_rate": ("Lower poverty", "Higher poverty"),
    "violent_crime_per_population": ("Lower violent crime", "Higher violent crime"),
    "property_crime_per_population": ("Lower property crime", "Higher property crime"),
}
# the same with the last four pairs turned, so that each phrase says what the value is
NAME_PHRASES_BY_VALUE = {
    **NAME_PHRASES,
    "unemployment_rate": ("Higher unemployment", "Lower unemployment"),
    "poverty_rate": ("Higher poverty", "Lower poverty"),
    "violent_crime_per_population": ("Higher violent crime", "Lower violent crime"),
    "property_crime_per_population": ("Higher property crime", "Lower property crime"),
}
NAME_Z_THRESHOLD = 0.35
NAME_MAX_PHRASES = 2

# trade-off rules, in order: (trigger phrases, text)
TRADEOFF_RULES = [
    (("High-rent", "Expensive housing"), "higher housing costs"),
    (("Car-dependent", "More spread out"), "less walkability"),
    (("Higher violent crime", "Higher property crime"), "more safety risk"),
    (("Snowier",), "harsher winters"),
    (("Higher poverty", "Higher unemployment"), "weaker economic conditions"),
]
TRADEOFF_DEFAULT = "high variation by metro"
BALANCED_CANDIDATES = ["Balanced Everyday Metros", "All-Around Cities", "Generalist Metros"]
# candidate names 1 to 3 and description, from two phrases or one ({a_lower}: in lower case)
TWO_PHRASE_TEXTS = ["{a} Hubs", "{a} + {b} Metros", "{a} / {b} Cities",
                    "Metros that skew {a_lower}, often also {b_lower}."]
ONE_PHRASE_TEXTS = ["{a} Hubs", "{a} Lifestyle Metros", "{a} Sweet-Spot Cities", "Metros that skew {a_lower}."]
BALANCED_DESCRIPTION = "A balanced mix of metros without a single dominating trait."

# selective winsorisation thresholds on robust-scaled columns
CLIP_SKEW_ABS = 0.5
CLIP_EXCESS_KURTOSIS = 0.5
CLIP_PCT_BEYOND_4 = 2.0

# K-means settings: k values, restarts, seed, PCA variance target, components kept
KMEANS_K = (5, 22)
KMEANS_STARTS = 10
KMEANS_SEED = 42
PCA_VARIANCE = 0.90
PCA_KEEP = 3

# ---------------------------------------------------------------- fixed values: census variables (code: name; in the order of the responses)
CENSUS_VARIABLES = {
    "B19013_001E": "MedianHouseholdIncome_B19013",
    "B01003_001E": "TotalPopulation_B01003",
    "B01002_001E": "MedianAge_B01002",
    "B01001_009E": "Male_22to24_B01001",
    "B01001_010E": "Male_25to29_B01001",
    "B01001_011E": "Male_30to34_B01001",
    "B01001_019E": "Male_65to66_B01001",
    "B01001_020E": "Male_67to69_B01001",
    "B01001_021E": "Male_70to74_B01001",
    "B01001_022E": "Male_75to79_B01001",
    "B01001_023E": "Male_80to84_B01001",
    "B01001_024E": "Male_85plus_B01001",
    "B01001_032E": "Female_22to24_B01001",
    "B01001_033E": "Female_25to29_B01001",
    "B01001_034E": "Female_30to34_B01001",
    "B01001_042E": "Female_65to66_B01001",
    "B01001_043E": "Female_67to69_B01001",
    "B01001_044E": "Female_70to74_B01001",
    "B01001_045E": "Female_75to79_B01001",
    "B01001_046E": "Female_80to84_B01001",
    "B01001_047E": "Female_85plus_B01001",
    "B17001_001E": "TotalPovertyUniverse_B17001",
    "B17001_002E": "BelowPoverty_B17001",
    "C24050_001E": "IndustryTotalEmployed_C24050",
    "C24050_002E": "IndustryAgForestryMining_C24050",
    "C24050_003E": "IndustryConstruction_C24050",
    "C24050_004E": "IndustryManufacturing_C24050",
    "C24050_005E": "IndustryWholesaleTrade_C24050",
    "C24050_006E": "IndustryRetailTrade_C24050",
    "C24050_007E": "IndustryTransportUtilities_C24050",
    "C24050_008E": "IndustryInformation_C24050",
    "C24050_009E": "IndustryFinanceRealEstate_C24050",
    "C24050_010E": "IndustryProfSciMgmtAdminWaste_C24050",
    "C24050_011E": "IndustryEducationHealthCare_C24050",
    "C24050_012E": "IndustryArtsRecAccommodationFood_C24050",
    "C24050_013E": "IndustryOtherServices_C24050",
    "C24050_014E": "IndustryPublicAdmin_C24050",
    "C24010_001E": "TotalEmployed_C24010",
    "C24010_003E": "ManagementBusiness_C24010",
    "C24010_004E": "ScienceEngineering_C24010",
    "C24010_006E": "ServiceOccupations_C24010",
    "C24010_007E": "SalesOffice_C24010",
    "C24010_008E": "Construction_C24010",
    "C24010_009E": "ProductionTransportation_C24010",
    "B15003_001E": "TotalPopulation25Plus_B15003",
    "B15003_022E": "BachelorsDegree_B15003",
    "B15003_023E": "MastersDegree_B15003",
    "B15003_024E": "ProfessionalDegree_B15003",
    "B15003_025E": "DoctorateDegree_B15003",
    "B02001_001E": "TotalRace_B02001",
    "B02001_002E": "WhiteAlone_B02001",
    "B02001_003E": "BlackAlone_B02001",
    "B02001_004E": "AmericanIndianAlaskaNative_B02001",
    "B02001_005E": "AsianAlone_B02001",
    "B02001_006E": "NativeHawaiianPacificIslander_B02001",
    "B02001_007E": "SomeOtherRace_B02001",
    "B02001_008E": "TwoOrMoreRaces_B02001",
    "B25064_001E": "MedianGrossRent_B25064",
    "B25077_001E": "MedianHomeValue_B25077",
    "B23025_003E": "LaborForce_B23025",
    "B23025_005E": "Unemployed_B23025",
}
# variables of the earlier year, for growth
CENSUS_PRIOR_VARIABLES = ["B01003_001E", "C24050_001E", "B25064_001E", "B25077_001E"]
# header of the unit code, and of the unit name
CENSUS_UNIT_HEADER = "metropolitan statistical area/micropolitan statistical area"
CENSUS_NAME_HEADER = "NAME"

# ---------------------------------------------------------------- fixed values: census shares (all in per cent)
INDUSTRY_TOTAL = "IndustryTotalEmployed_C24050"
OCCUPATION_TOTAL = "TotalEmployed_C24010"
CENSUS_SHARES = {
    # share: (numerators, denominator)
    "industry_ag_forestry_mining_share": (["IndustryAgForestryMining_C24050"], INDUSTRY_TOTAL),
    "industry_construction_share": (["IndustryConstruction_C24050"], INDUSTRY_TOTAL),
    "industry_manufacturing_share": (["IndustryManufacturing_C24050"], INDUSTRY_TOTAL),
    "industry_wholesale_share": (["IndustryWholesaleTrade_C24050"], INDUSTRY_TOTAL),
    "industry_retail_share": (["IndustryRetailTrade_C24050"], INDUSTRY_TOTAL),
    "industry_transport_utilities_share": (["IndustryTransportUtilities_C24050"], INDUSTRY_TOTAL),
    "industry_information_share": (["IndustryInformation_C24050"], INDUSTRY_TOTAL),
    "industry_finance_real_estate_share": (["IndustryFinanceRealEstate_C24050"], INDUSTRY_TOTAL),
    "industry_prof_sci_mgmt_admin_share": (["IndustryProfSciMgmtAdminWaste_C24050"], INDUSTRY_TOTAL),
    "industry_education_health_share": (["IndustryEducationHealthCare_C24050"], INDUSTRY_TOTAL),
    "industry_arts_rec_accommodation_food_share": (["IndustryArtsRecAccommodationFood_C24050"], INDUSTRY_TOTAL),
    "industry_other_services_share": (["IndustryOtherServices_C24050"], INDUSTRY_TOTAL),
    "industry_public_admin_share": (["IndustryPublicAdmin_C24050"], INDUSTRY_TOTAL),
    "white_collar_share": (["ManagementBusiness_C24010", "ScienceEngineering_C24010"], OCCUPATION_TOTAL),
    "blue_collar_share": (["Construction_C24010", "ProductionTransportation_C24010"], OCCUPATION_TOTAL),
    "service_job_share": (["ServiceOccupations_C24010"], OCCUPATION_TOTAL),
    "sales_share": (["SalesOffice_C24010"], OCCUPATION_TOTAL),
    "bachelors_or_higher_share": (["BachelorsDegree_B15003", "MastersDegree_B15003", "ProfessionalDegree_B15003",
                                   "DoctorateDegree_B15003"], "TotalPopulation25Plus_B15003"),
    "age_22_34_share": (["age_22_34_total"], "TotalPopulation_B01003"),
    "age_65_plus_share": (["age_65_plus_total"], "TotalPopulation_B01003"),
    "unemployment_rate": (["Unemployed_B23025"], "LaborForce_B23025"),
    "poverty_rate": (["BelowPoverty_B17001"], "TotalPovertyUniverse_B17001"),
}
# age totals: bucket names, each once for men and once for women
AGE_BUCKETS = {
    "age_22_34_total": ["22to24", "25to29", "30to34"],
    "age_65_plus_total": ["65to66", "67to69", "70to74", "75to79", "80to84", "85plus"],
}
RACE_TOTAL = "TotalRace_B02001"
RACE_GROUPS = ["WhiteAlone_B02001", "BlackAlone_B02001", "AmericanIndianAlaskaNative_B02001", "AsianAlone_B02001",
               "NativeHawaiianPacificIslander_B02001", "SomeOtherRace_B02001", "TwoOrMoreRaces_B02001"]
# gazetteer column: name in the panel
GAZETTEER_COLUMNS = {"ALAND": "land_area_m2", "AWATER": "water_area_m2", "ALAND_SQMI": "land_area_sqmi",
                     "AWATER_SQMI": "water_area_sqmi", "INTPTLAT": "centroid_lat", "INTPTLONG": "centroid_lon"}

# ---------------------------------------------------------------- fixed values: health measures (id: feature)
HEALTH_MEASURES = {
    "OBESITY": "obesity_share", "LPA": "physical_inactivity_share", "DEPRESSION": "depression_share",
    "CASTHMA": "current_asthma_share", "DIABETES": "diabetes_share", "STROKE": "stroke_share",
    "CHD": "coronary_heart_disease_share", "ARTHRITIS": "arthritis_share", "DISABILITY": "any_disability_share",
    "CSMOKING": "current_smoking_share", "BINGE": "binge_drinking_share",
}

# ---------------------------------------------------------------- fixed values: station files
STATION_REQUIRED = ["station", "latitude", "longitude", "name", "month"]
STATION_MEASURES = ["mly_tavg_normal", "mly_prcp_normal", "mly_snow_normal"]

# ---------------------------------------------------------------- fixed values: clustering columns
# numeric columns that clustering does not look at: identifiers, raw counts and areas, station facts
CLUSTER_DROP = [
    "contains_imputed", "TotalPopulation_B01003", "TotalPovertyUniverse_B17001", "BelowPoverty_B17001",
    "IndustryTotalEmployed_C24050", "IndustryAgForestryMining_C24050", "IndustryConstruction_C24050",
    "IndustryManufacturing_C24050", "IndustryWholesaleTrade_C24050", "IndustryRetailTrade_C24050",
    "IndustryTransportUtilities_C24050", "IndustryInformation_C24050", "IndustryFinanceRealEstate_C24050",
    "IndustryProfSciMgmtAdminWaste_C24050", "IndustryEducationHealthCare_C24050",
    "IndustryArtsRecAccommodationFood_C24050", "IndustryOtherServices_C24050", "IndustryPublicAdmin_C24050",
    "TotalEmployed_C24010", "ManagementBusiness_C24010", "ScienceEngineering_C24010", "ServiceOccupations_C24010",
    "SalesOffice_C24010", "Construction_C24010", "ProductionTransportation_C24010", "TotalPopulation25Plus_B15003",
    "BachelorsDegree_B15003", "MastersDegree_B15003", "ProfessionalDegree_B15003", "DoctorateDegree_B15003",
    "TotalRace_B02001", "WhiteAlone_B02001", "BlackAlone_B02001", "AmericanIndianAlaskaNative_B02001",
    "AsianAlone_B02001", "NativeHawaiianPacificIslander_B02001", "SomeOtherRace_B02001", "TwoOrMoreRaces_B02001",
    "LaborForce_B23025", "Unemployed_B23025", "age_22_34_total", "age_65_plus_total", "land_area_m2", "water_area_m2",
    "land_area_sqmi", "water_area_sqmi", "centroid_lat", "centroid_lon", "nat_walk_index_mean",
    "population_density_mean", "n_tracts", "total_population_weight", "violent_crime_count", "property_crime_count",
    "total_crime_count", "station_distance_km", "snow_binary", "n_months_available",
]
CLUSTER_ASINH = ["job_growth", "population_growth"]
CLUSTER_LOG1P = [
    "MedianGrossRent_B25064", "MedianHomeValue_B25077", "activity_density_mean", "age_22_34_share", "age_65_plus_share",
    "annual_snowfall", "blue_collar_share", "industry_ag_forestry_mining_share",
    "industry_arts_rec_accommodation_food_share", "industry_finance_real_estate_share", "industry_information_share",
    "industry_prof_sci_mgmt_admin_share", "industry_public_admin_share", "intersection_density_mean",
    "population_density_per_sq_mile", "poverty_rate", "property_crime_per_population", "sales_share",
    "unemployment_rate", "violent_crime_per_population",
]
# features that names and label reports look at
NAME_FEATURES = [
    "MedianHouseholdIncome_B19013", "MedianHomeValue_B25077", "MedianGrossRent_B25064", "bachelors_or_higher_share",
    "unemployment_rate", "poverty_rate", "violent_crime_per_population", "property_crime_per_population",
    "nat_walk_index_pop_weighted", "population_density_per_sq_mile", "intersection_density_mean",
    "activity_density_mean", "diversity_index", "avg_annual_temp", "temp_seasonality", "annual_precipitation",
    "annual_snowfall", "job_growth", "population_growth", "median_home_value_growth", "median_rent_growth",
]
# cluster levels: name, number of clusters
CLUSTER_LEVELS = {"cluster": 5, "sub_cluster": 22}
