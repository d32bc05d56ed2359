"""Fixed values of the rental domain: ZIP codes, categories, patterns and score labels that results depend on."""

# Fixed values.
START_DATE = "2018-01-01"
CITY_ZIPS = [
    "94102", "94103", "94104", "94105", "94107", "94108", "94109", "94110", "94111", "94112", "94114", "94115", "94116", "94117",
    "94118", "94121", "94122", "94123", "94124", "94127", "94128", "94129", "94130", "94131", "94132", "94133", "94134", "94158",
]
SPARSE_ZIPS = ["94104", "94111", "94127", "94128", "94130"]
CENSUS_DROP_ZIPS = ["94104"]
RENT_RANGE = (500.0, 10000.0)
SCOPE_RANGE = (2000.0, 8000.0)
CENSUS_SENTINEL = -666666666
MONTH_COLUMN = r"^\d{4}-\d{2}-\d{2}$"
VIOLENT = [
    "Assault", "Robbery", "Sex Offense", "Homicide", "Weapons Offense", "Weapons Carrying Etc", "Weapons Offence",
    "Human Trafficking, Commercial Sex Acts", "Human Trafficking (A), Commercial Sex Acts", "Human Trafficking (B), Involuntary Servitude",
    "Human Trafficking", "Rape", "Offences Against The Family And Children",
]
PROPERTY = [
    "Larceny Theft", "Burglary", "Motor Vehicle Theft", "Motor Vehicle Theft?", "Vandalism", "Malicious Mischief", "Arson",
    "Stolen Property", "Embezzlement", "Forgery And Counterfeiting", "Fraud", "Recovered Vehicle",
]
FLOORPLAN = r"(?U)(?i)(Studio|\d+\s+Beds\+|\d+\s+Beds|\d+\s+Bed)\s+\$\s*([\d,]+)\+?"
UNIT_PRICE = r"(?U)(?i)(Studio|\d+\s+Beds?\+?)\s+\$\s*([\d,]+)(\+?)"
FIRST_RENT = r"(?U)\$\s*([\d,]+)\+?"
SQFT = r"(?U)(?i)([\d,]+)\s*sq\.?\s*ft\.?"
SCORE_LABELS = {
    "walk": [(90, "Walker's Paradise"), (70, "Very Walkable"), (50, "Somewhat Walkable"), (25, "Car-Dependent"), (0, "Car-Dependent")],
    "transit": [(90, "Rider's Paradise"), (70, "Excellent Transit"), (50, "Good Transit"), (25, "Some Transit"), (0, "Minimal Transit")],
    "bike": [(90, "Biker's Paradise"), (70, "Very Bikeable"), (50, "Bikeable"), (25, "Somewhat Bikeable"), (0, "Somewhat Bikeable")],
}
SIZE_FACTORS = {0: 0.70, 1: 0.90, 2: 1.10, 3: 1.35, 4: 1.55, 5: 1.70}
UNIT_AT = r"(?i)^\s*(?:unit|apt|apartment|suite|ste|#)\s*[\w-]+\s+at\s+(.+)$"
TRAILING_UNIT = r"(?i),?\s*(?:unit|apt|apartment|suite|ste|#)\s*[\w-]+\s*$"
SLUG_STOPS = ["san", "francisco", "sf", "ca", "california", "unit", "apt", "apartment", "suite", "ste"]
URL_MARKERS = ["captcha", "access denied", "akamai", "interstitial"]
BLOCK_MARKERS = [
    "captcha", "access denied", "unusual traffic", "verify you are human", "pardon our interruption", "are you a robot", "akamai",
    "access to this page",
]
SQFT_COLUMNS = ["sqft", "square_feet", "sq_ft", "square_feet_listed"]
UNIT_COLUMNS = ["title", "beds_baths", "pricing", "address", "zip_code", "url", "scraped_at"]
UNIT_KEYS = ["zip_code", "bedrooms", "bathrooms", "rent_usd"]
LISTING_COLUMNS = ["zip_code", "date", "rent_usd", "beds_baths", "sqft", "address", "url"]
MODEL_NUMERIC = [
    "bedrooms", "bathrooms", "walk_score", "transit_score", "census_median_income", "census_renter_ratio", "census_vacancy_rate",
    "crime_total_month_zip_log1p_latest", "zori_baseline", "zhvi_level", "zhvi_12mo_delta", "redfin_mom_pct", "redfin_yoy_pct",
    "bedrooms_x_census_income", "walk_score_x_transit_score",
]
FEATURE_COLUMNS = ["zip_code", "date", "listing_month", "rent_usd", "beds_baths", *MODEL_NUMERIC]
