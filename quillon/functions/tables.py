"""Codes, units and words that results must agree on."""

# Condition code, phrase, slug.
CONDITIONS = [
    (0, "Clear sky", "clear"), (1, "Mainly clear", "mainly_clear"), (2, "Partly cloudy", "partly_cloudy"), (3, "Overcast", "overcast"),
    (45, "Fog", "fog"), (48, "Depositing rime fog", "depositing_rime_fog"), (51, "Light drizzle", "light_drizzle"),
    (53, "Moderate drizzle", "moderate_drizzle"), (55, "Dense drizzle", "dense_drizzle"),
    (56, "Light freezing drizzle", "light_freezing_drizzle"), (57, "Dense freezing drizzle", "dense_freezing_drizzle"),
    (61, "Slight rain", "slight_rain"), (63, "Moderate rain", "moderate_rain"), (65, "Heavy rain", "heavy_rain"),
    (66, "Light freezing rain", "light_freezing_rain"), (67, "Heavy freezing rain", "heavy_freezing_rain"),
    (71, "Slight snow fall", "slight_snow_fall"), (73, "Moderate snow fall", "moderate_snow_fall"), (75, "Heavy snow fall", "heavy_snow_fall"),
    (77, "Snow grains", "snow_grains"), (80, "Slight rain showers", "slight_rain_showers"), (81, "Moderate rain showers", "moderate_rain_showers"),
    (82, "Violent rain showers", "violent_rain_showers"), (85, "Slight snow showers", "slight_snow_showers"),
    (86, "Heavy snow showers", "heavy_snow_showers"), (95, "Thunderstorm", "thunderstorm"),
    (96, "Thunderstorm with slight hail", "thunderstorm_with_slight_hail"), (99, "Thunderstorm with heavy hail", "thunderstorm_with_heavy_hail"),
]

# The sixteen points of the compass from north, clockwise.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

# Words of little weight.
STOPWORDS = """
the a an and or but if then than that this these those there their them they it its is are was were be been being am do does did done
have has had having will would shall should can could may might must of in on at to for with without from by as into onto over under
about between through during before after again once here when where why how what which who whom whose i you your yours we our ours he
him his she her hers me my mine so such some any all both each few most other others own same very just only also too one ones like well
get got please sure certainly absolutely definitely let know answer answers question questions following based according provide provided
information overall summary conclusion however therefore thus moreover furthermore additionally additional basically actually simply
really happy help hope note noting worth further feel free glad assist ask hesitate regarding mentioned essentially generally typically
important remember keep mind context given use using need want make take see look find think believe seems appears call invoke execute
""".split()

# Number words and their digits ("one" is not among them).
NUMERALS = {
    "zero": "0", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70",
    "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000",
    "trillion": "1000000000000",
}

# Scale words and suffixes, as powers of ten.
SCALES = {"thousand": 3, "k": 3, "million": 6, "m": 6, "mn": 6, "billion": 9, "b": 9, "bn": 9, "trillion": 12, "t": 12, "tn": 12}

# Words that negate what follows.
NEGATORS = """
not no never none neither nor cannot cant isn aren wasn weren doesn don didn won unable without
""".split()

# The three polarity axes, words for and against.
AXES = {
    "verdict": (
        """yes true correct accurate supported valid confirmed verified approved pass passed present likely allowed available active
        succeeded""".split(),
        """no false incorrect inaccurate refuted invalid wrong unfounded unsupported rejected fail failed absent unlikely denied
        unavailable inactive expired revoked""".split(),
    ),
    "authenticity": (
        "human real authentic genuine clean benign safe legitimate organic".split(),
        "ai fake forged synthetic malicious phishing infected spam fraudulent deepfake bot".split(),
    ),
    "direction": (
        """rise rises rising rose up upward higher increase increases increased gain gains bullish growth grew appreciate above more better
        stronger buy positive warmer faster hot warm open enabled secure encrypted success bull strengthened strengthen appreciated gained
        rallied climbed surged outperformed""".split(),
        """fall falls falling fell down downward lower decrease decreases decreased loss losses bearish decline declines shrink depreciate
        below less worse weaker sell negative cooler slower cold cool closed disabled insecure unencrypted failure bear weakened weaken
        depreciated lost slumped slipped plunged underperformed""".split(),
    ),
}
