"""Fixed values that results depend on: labels, word lists, thresholds, codes."""

# Canonical column order of article records.
ARTICLE_COLUMNS = [
    "article_id", "source", "article_title", "article_url", "date_published", "country",
    "region_department", "locality", "latitude", "longitude", "sector", "actor_company",
    "community_actor", "event_type", "environmental_issue", "source_text_excerpt",
    "extraction_method", "notes",
]
ADMIN_COLUMNS = ["country (admin 0)", "region (admin 1)", "municipality (admin 2)", "sub-district (admin 3)", "gadm_id"]
LEGACY_ADMIN_COLUMNS = ["admin_2", "admin_3", "gadm_id"]

GEOCODE_COLUMNS = ["latitude", "longitude", "geocode_precision", "geocode_query", "geocode_display_name", "geocode_status"]

# Display labels.
SECTOR_LABELS = {
    "mining": "Mining", "oil_gas": "Oil & Gas", "logging_deforestation": "Logging / Deforestation",
    "infrastructure": "Infrastructure", "agriculture": "Agriculture", "protected_areas": "Protected Areas",
    "other": "Other", "": "Unclassified",
}
SECTOR_COLORS = {
    "mining": "red", "oil_gas": "black", "logging_deforestation": "darkgreen", "infrastructure": "blue",
    "agriculture": "orange", "protected_areas": "purple", "other": "gray", "": "lightgray",
}
EVENT_LABELS = {
    "pollution": "Pollution", "enforcement_action": "Enforcement Action", "violence": "Violence",
    "legal": "Legal Action", "consultation_dispute": "Consultation Dispute", "protest": "Protest",
    "displacement": "Displacement", "": "Unclassified",
}

# Title comparison.
RATIO_LEAST = 0.60
STRONG_SHARED = 2
OVERLAP_LEAST = 0.30
KEYWORD_LENGTH = 4
DISTINCTIVE_LENGTH = 5
WINDOW_DAYS = 120
STOPWORDS = [
    "the", "a", "an", "of", "in", "on", "to", "and", "for", "with", "at", "by", "from", "is", "are", "was", "were",
    "as", "that", "this", "it", "over", "after", "amid", "says", "say", "new", "news",
    "el", "la", "los", "las", "de", "del", "en", "y", "con", "por", "para", "un", "una", "que", "se", "su", "sus",
    "sobre", "tras", "dice", "nuevo", "nueva",
    "o", "os", "do", "da", "dos", "das", "em", "e", "com", "uma", "apos", "diz", "novo", "nova",
]
TITLE_CHARACTERS = "a-z0-9áàâãéèêíïóôõöúüçñ"

# Precision of places.
PRECISION_RANK = {
    "town": 3, "village": 3, "suburb": 3, "quarter": 3, "hamlet": 3, "locality": 3, "amenity": 3, "office": 3,
    "tourism": 3, "feature": 2, "region": 1, "country": 0,
}
UNKNOWN_RANK = 2
ADDRESS_PRECISION = {
    "town": ["city", "town", "village", "hamlet", "suburb", "municipality", "locality"],
    "region": ["state", "province", "region", "county", "administrative"],
    "country": ["country"],
    "feature": ["river", "stream", "water", "natural", "protected_area", "national_park"],
}
COARSE_HINTS = ["region", "country"]
COARSE_PRECISIONS = ["region", "country", "state", "feature", "unknown", ""]

# Country codes.
ISO2 = {
    "Colombia": "co", "Peru": "pe", "Ecuador": "ec", "Bolivia": "bo", "Brazil": "br", "Venezuela": "ve",
    "Argentina": "ar", "Chile": "cl", "Guatemala": "gt", "Mexico": "mx", "Paraguay": "py", "Uruguay": "uy",
    "Guyana": "gy", "Suriname": "sr", "French Guiana": "gf", "Panama": "pa", "Nicaragua": "ni", "Honduras": "hn",
    "Costa Rica": "cr",
}
ISO3 = {
    "Argentina": "ARG", "Bolivia": "BOL", "Brazil": "BRA", "Brasil": "BRA", "Chile": "CHL", "Colombia": "COL",
    "Ecuador": "ECU", "Guyana": "GUY", "Paraguay": "PRY", "Peru": "PER", "Perú": "PER", "Suriname": "SUR",
    "Uruguay": "URY", "Venezuela": "VEN",
}
THIRD_LEVEL = ["PER", "ECU"]
SHORTEST_PLACE = 4

# Raster constants.
SCALE, SHIFT = 0.0000275, -0.2
CLOUD_BELOW, SCENES_A_MONTH = 80.0, 10
PIXEL = 30 / 111_320  # degrees
BAND_ASSETS = {
    "blue": ["blue", "SR_B2", "SR_B1"], "green": ["green", "SR_B3", "SR_B2"], "red": ["red", "SR_B4", "SR_B3"],
    "nir": ["nir08", "SR_B5", "SR_B4"], "swir1": ["swir16", "SR_B6", "SR_B5"],
}
