"""Word lists and lookup tables of the normalisation."""

# Which words stand for which, and which are dropped, is part of the semantics.
NAME_WORDS = {
    "pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated", "co": "company", "intl": "international",
    "assn": "association", "svc": "service", "svcs": "services", "mfg": "manufacturing", "bros": "brothers", "dept": "department",
    "univ": "university", "mgmt": "management", "amp": "and", "lnc": "incorporated",
}
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "avnue": "avenue", "blvd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "hwy": "highway", "pkwy": "parkway", "pl": "place", "cir": "circle", "ter": "terrace", "sq": "square",
    "apt": "apartment", "ste": "suite", "bldg": "building", "flr": "floor", "nr": "near", "opp": "opposite", "rte": "route",
    "n": "north", "s": "south", "e": "east", "w": "west",
}
ORDINALS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9",
    "tenth": "10", "eleventh": "11", "twelfth": "12", "thirteenth": "13", "fourteenth": "14", "fifteenth": "15", "sixteenth": "16",
    "seventeenth": "17", "eighteenth": "18", "nineteenth": "19", "twentieth": "20", "thirtieth": "30", "fortieth": "40", "fiftieth": "50",
    "sixtieth": "60", "seventieth": "70", "eightieth": "80", "ninetieth": "90", "hundredth": "100",
}
NULL_WORDS = ("null", "nan", "none", "na", "nil")
NUMBER_WORDS = ("no", "number", "nr", "num")
HONORIFICS = ("sri", "shri", "smt", "dr", "mr", "mrs", "ms", "the", "messrs")
LEGAL_WORDS = ("private", "limited", "incorporated", "llc", "company", "corporation", "llp", "the", "and", "of", "ltd", "pvt", "inc", "co", "com")
DOMAINS = ("com", "net", "org", "info", "biz", "co", "in", "fr", "us")
STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj",
    "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
    "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "punjab": "pb",
    "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk",
    "west bengal": "wb", "delhi": "dl", "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "ladakh": "la",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi",
    "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh",
    "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
    "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}
APOSTROPHES = "'‘’`´"
PUNCTUATION = "[!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_{|}~‐-―“-‟ ·«»•]"
