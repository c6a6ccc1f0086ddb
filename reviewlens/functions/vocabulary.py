"""Fixed values the operators rely on; every one can be overridden by a parameter."""

# Sentiment labels of the two review vocabularies.
LOWER_LABELS = ("positive", "neutral", "negative")
TITLE_LABELS = ("Positive", "Neutral", "Negative")

# Aspects that say nothing about the product itself.
NOISE_ASPECTS = ("Generic", "Account", "Customer-Service", "Browser")

# The six aspects shown on a device card, in display order.
RATED_ASPECTS = ("Performance", "Design", "Display", "Battery", "Price", "Software")

# Operating-system groups a competitor may belong to.
COMPETITOR_SYSTEMS = ("Apple OS", "Google OS", "Windows OS")

# The diverging heat scale, low / middle / high, as (red, green, blue).
HEAT_LOW = (0xB0, 0x34, 0x3C)
HEAT_MIDDLE = (0xDC, 0xDC, 0xDC)
HEAT_HIGH = (0x34, 0x7C, 0x47)

# Weights of the aspect ranking.
SENTIMENT_WEIGHT = 1
VOLUME_WEIGHT = 3

UNKNOWN = "Unknown"
TOTAL = "TOTAL"
OVERALL = "OVERALL"
UNAVAILABLE = "Device not available"
