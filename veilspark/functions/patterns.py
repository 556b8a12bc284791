"""Fixed values that decide results: patterns, word lists and lookup tables.

Patterns are in Java's dialect.  Java's \\b follows Unicode letters, the behaviour to match follows ASCII,
so B stands for an ASCII word boundary.  White space is JavaScript's set, spelled out in WS.
"""

from __future__ import annotations

B = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
WS_CHARS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_CHARS}]"

# The seven passes in order of priority.
PASSES = (
    ("email", rf"(?i){B}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{B}"),
    ("iban", rf"{B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{11,30}}{B}"),
    ("credit_card", rf"{B}(?:\d[ -]?){{13,19}}{B}"),
    ("ip_address", rf"{B}(?:\d{{1,3}}\.){{3}}\d{{1,3}}{B}"),
    ("ip_address", rf"(?i){B}(?:[A-F0-9]{{1,4}}:){{2,7}}[A-F0-9]{{1,4}}{B}"),
    ("date", rf"{B}(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{2}}|\d{{4}})){B}"),
    ("phone", rf"(?:\+?\d{{1,3}}[{WS_CHARS}./-]?)?(?:\(?\d{{2,5}}\)?[{WS_CHARS}./-]?){{2,}}\d{{2,}}"),
)
#: A run of characters that may be part of a phone number and is too long for Java's recursive matcher.
LONG_RUN = rf"[\d{WS_CHARS}./()+-]{{1000}}"

# The quick patterns of the scan gate, for texts of fewer than ten characters.
QUICK = (
    r"[\w.+-]+@[\w-]+\.[\w.-]+",
    rf"(?:\+?\d[{WS_CHARS}\-/.()]*){{7,}}",
    rf"{B}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{B}",
    rf"{B}(?:\d[ -]?){{13,19}}{B}",
)
SCAN_FROM = 10
RESTORE_FROM = 5

# The closed set of detector categories.
CATEGORIES = (
    "email", "iban", "credit_card", "phone", "ip_address", "date", "name", "address",
    "company", "national_id", "passport", "driver_license", "medical_record", "other",
)

# Placeholder of each mask category, and the mask category of detector categories and model labels.
PLACEHOLDERS = {
    "person": "<PRIVATE_PERSON>",
    "email": "<PRIVATE_EMAIL>",
    "phone": "<PRIVATE_PHONE>",
    "address": "<PRIVATE_ADDRESS>",
    "date": "<PRIVATE_DATE>",
    "url": "<PRIVATE_URL>",
    "account": "<PRIVATE_ACCOUNT>",
    "iban": "<PRIVATE_IBAN>",
    "credit_card": "<PRIVATE_CARD>",
    "ip": "<PRIVATE_IP>",
    "secret": "<SECRET>",
}
MASK_OF_CATEGORY = {
    "name": "person",
    "email": "email",
    "phone": "phone",
    "address": "address",
    "date": "date",
    "national_id": "secret",
    "credit_card": "credit_card",
    "iban": "iban",
    "ip_address": "ip",
    "company": "secret",
    "passport": "secret",
    "driver_license": "secret",
    "medical_record": "secret",
    "other": "secret",
}
MASK_OF_LABEL = {
    "account_number": "account",
    "private_address": "address",
    "private_email": "email",
    "private_person": "person",
    "private_phone": "phone",
    "private_url": "url",
    "private_date": "date",
    "secret": "secret",
}

# Streams that synthetic digits and letters are drawn from.
DIGITS = "5117064928351047283946501928374650918273645546372819"
UPPER = "QWERTYUPASDFGHJKLZXCVBNM"
LOWER = UPPER.lower()
BANK = "50010517"

# Country calling codes, longest first.
CALLING_CODES = (
    "998", "995", "994", "977", "976", "975", "974", "973", "972", "971", "386", "385", "372", "370", "359", "358", "356",
    "354", "353", "352", "351", "234", "91", "90", "86", "82", "81", "65", "64", "61", "55", "54", "52", "49", "48", "47",
    "46", "45", "44", "43", "41", "39", "34", "33", "32", "31", "30", "27", "20", "7", "1",
)

# Tokens of names.
PARTICLES = ("von", "van", "de", "del", "da", "di", "bin", "al")
NOT_NAMES = (
    "alt", "avatar", "banner", "card", "circle", "cover", "crop", "cropped", "file", "gmbh", "headshot", "hero", "image",
    "img", "inc", "kg", "llc", "ltd", "logo", "photo", "picture", "portrait", "profile", "round", "square", "thumbnail",
    "thumb", "ug",
)
IMAGE = r"jpe?g|png|gif|webp|avif|svg"

# Given names (male, female, neutral) and surnames by locale.
NAMES = {
    "de": (
        ("Max", "Jonas", "Leon", "Felix", "Paul", "Lukas", "Simon", "David", "Tim", "Jan", "Moritz", "Thomas"),
        ("Anna", "Sophie", "Lena", "Lea", "Julia", "Clara", "Emma", "Laura", "Marie", "Hanna", "Sarah"),
        ("Alex", "Robin", "Sam", "Toni", "Kim"),
        ("Schneider", "Fischer", "Weber", "Meyer", "Becker", "Hoffmann", "Schäfer", "Koch", "Bauer", "Klein"),
    ),
    "en": (
        ("James", "Oliver", "Henry", "Lucas", "Daniel", "Ethan", "Jack", "Noah", "Samuel", "Miles"),
        ("Emily", "Hannah", "Olivia", "Chloe", "Grace", "Lily", "Sophie", "Emma", "Mia", "Ella"),
        ("Alex", "Taylor", "Jordan", "Avery", "Casey"),
        ("Miller", "Carter", "Bennett", "Parker", "Collins", "Foster", "Reed", "Hughes", "Bailey", "Walker"),
    ),
    "fr": (
        ("Louis", "Gabriel", "Hugo", "Jules", "Théo", "Arthur", "Lucas", "Nathan"),
        ("Camille", "Léa", "Chloé", "Jade", "Manon", "Sarah", "Emma", "Zoé"),
        ("Alex", "Charlie", "Lou", "Noa"),
        ("Martin", "Bernard", "Dubois", "Laurent", "Petit", "Moreau", "Simon", "Michel"),
    ),
    "es": (
        ("Mateo", "Daniel", "Pablo", "Diego", "Lucas", "Javier", "Adrián", "Marco"),
        ("Lucía", "Sofía", "Marta", "Elena", "Carla", "Paula", "Inés", "Alba"),
        ("Alex", "Noa", "Dani", "Cris"),
        ("García", "López", "Martínez", "Sánchez", "Romero", "Navarro", "Torres", "Ruiz"),
    ),
    "it": (
        ("Luca", "Marco", "Matteo", "Davide", "Andrea", "Simone", "Paolo", "Enzo"),
        ("Giulia", "Sofia", "Chiara", "Martina", "Elena", "Alice", "Sara", "Lucia"),
        ("Alex", "Sam", "Nico", "Vale"),
        ("Rossi", "Bianchi", "Romano", "Gallo", "Costa", "Mancini", "Lombardi", "Moretti"),
    ),
    "nl": (
        ("Daan", "Bram", "Lars", "Sem", "Milan", "Jesse", "Thijs", "Luuk"),
        ("Emma", "Sophie", "Julia", "Tess", "Lotte", "Noor", "Sanne", "Eva"),
        ("Alex", "Sam", "Noa", "Robin"),
        ("De Vries", "Jansen", "Bakker", "Visser", "Smit", "Meijer", "De Boer", "Mulder"),
    ),
}

# Forms of address, their gender and locale.
TITLES = (
    (("herr",), "male", "de"),
    (("frau",), "female", "de"),
    (("mr", "mr."), "male", "en"),
    (("mrs", "mrs.", "ms", "ms.", "miss"), "female", "en"),
    (("monsieur",), "male", "fr"),
    (("madame", "mlle"), "female", "fr"),
    (("señor", "senor"), "male", "es"),
    (("señora", "senora", "sra", "sra."), "female", "es"),
    (("signor", "sig."), "male", "it"),
    (("signora", "sig.ra"), "female", "it"),
    (("heer", "dhr", "dhr."), "male", "nl"),
    (("mevrouw", "mevr", "mevr."), "female", "nl"),
)

# Addresses (street, number, postal code, city, state) by country, and what the country is called.
ADDRESSES = {
    "de": (
        (("Bergstraße", "27", "50667", "Köln", ""), ("Lindenweg", "14", "20095", "Hamburg", ""), ("Schillerstraße", "8", "04109", "Leipzig", ""), ("Goethestraße", "19", "80331", "München", "")),
        ("Deutschland", "Germany", "DE"),
    ),
    "at": (
        (("Mariahilfer Straße", "33", "1070", "Wien", ""), ("Herrengasse", "21", "8010", "Graz", ""), ("Getreidegasse", "9", "5020", "Salzburg", ""), ("Landstraßer Hauptstraße", "18", "1030", "Wien", "")),
        ("Österreich", "Austria", "AT"),
    ),
    "ch": (
        (("Bahnhofstrasse", "18", "8001", "Zürich", ""), ("Rue du Rhône", "24", "1204", "Genève", ""), ("Freie Strasse", "12", "4001", "Basel", ""), ("Marktgasse", "31", "3011", "Bern", "")),
        ("Schweiz", "Switzerland", "CH"),
    ),
    "us": (
        (("Cedar Ave", "742", "97205", "Portland", "OR"), ("Maple Street", "918", "80203", "Denver", "CO"), ("Lakeview Drive", "155", "53703", "Madison", "WI"), ("Oak Ridge Road", "481", "78701", "Austin", "TX")),
        ("USA", "United States", "US"),
    ),
    "uk": (
        (("Willow Road", "28", "M1 4AE", "Manchester", ""), ("Bridge Street", "39", "LS1 4DY", "Leeds", ""), ("Kingsway", "14", "BS1 5AH", "Bristol", ""), ("Rose Lane", "7", "L1 8JQ", "Liverpool", "")),
        ("United Kingdom", "United Kingdom", "UK"),
    ),
    "fr": (
        (("Rue des Tilleuls", "12", "69002", "Lyon", ""), ("Avenue Victor Hugo", "8", "33000", "Bordeaux", ""), ("Boulevard Saint-Michel", "21", "31000", "Toulouse", ""), ("Rue de la Paix", "4", "44000", "Nantes", "")),
        ("France", "France", "FR"),
    ),
    "es": (
        (("Calle Mayor", "24", "28013", "Madrid", ""), ("Avenida del Puerto", "11", "46002", "Valencia", ""), ("Calle de Alcalá", "63", "50001", "Zaragoza", ""), ("Paseo del Prado", "17", "29015", "Málaga", "")),
        ("España", "Spain", "ES"),
    ),
    "it": (
        (("Via Roma", "18", "20121", "Milano", ""), ("Corso Vittorio Emanuele", "42", "10121", "Torino", ""), ("Via Garibaldi", "9", "40121", "Bologna", ""), ("Piazza Verdi", "6", "35122", "Padova", "")),
        ("Italia", "Italy", "IT"),
    ),
    "nl": (
        (("Lindestraat", "15", "1012 AB", "Amsterdam", ""), ("Prinsengracht", "66", "3011 CE", "Rotterdam", ""), ("Stationsweg", "9", "3511 ED", "Utrecht", ""), ("Noorderstraat", "24", "9711 LM", "Groningen", "")),
        ("Nederland", "Netherlands", "NL"),
    ),
}

# Company names by locale, and legal forms in the order in which they are tried.
COMPANIES = {
    "de": ("Nordlicht", "Rheinblick", "Morgenstern", "Stadtwald", "Bergkern", "Elbbogen"),
    "en": ("Northshore", "Riverstone", "Oakfield", "Clearbridge", "Brightwell", "Westhaven"),
    "fr": ("Montclair", "Rivesud", "Beaufort", "Clairmont", "Valdor", "Lumière"),
    "es": ("Monteclaro", "Rioalto", "Solverde", "Pradonorte", "Puertoluz", "Llanura"),
    "it": ("Belmonte", "Novafonte", "Valleverde", "Stellalta", "Pianoro", "Rivabella"),
    "nl": ("Noorddam", "Rijnzicht", "Zonhoven", "Waterkant", "Lindenhof", "Brugstede"),
}
LEGAL_FORMS = (
    (r"\bGmbH & Co\. KG\b$", "de"),
    (r"\bUG\s*\(haftungsbeschränkt\)\b$", "de"),
    (r"\bGmbH\b$", "de"),
    (r"\bAG\b$", "de"),
    (r"\bKG\b$", "de"),
    (r"\bOHG\b$", "de"),
    (r"\be\.K\.?$", "de"),
    (r"\bLLC\b$", "en"),
    (r"\bInc\.?$", "en"),
    (r"\bLtd\.?$", "en"),
    (r"\bCorp\.?$", "en"),
    (r"\bCorporation\b$", "en"),
    (r"\bS\.A\.R\.L\.?$", "fr"),
    (r"\bSARL\b$", "fr"),
    (r"\bSAS\b$", "fr"),
    (r"\bS\.L\.?$", "es"),
    (r"\bSL\b$", "es"),
    (r"\bS\.r\.l\.?$", "it"),
    (r"\bSpA\b$", "it"),
    (r"\bBV\b$", "nl"),
    (r"\bNV\b$", "nl"),
)

# Rules (locale, letters, words) by which a text's locale is guessed, in order; else en.
LOCALE_RULES = (
    ("de", "[äöüß]", r"\b(Herr|Frau|Straße|Strasse|Weg|Allee|GmbH|AG)\b"),
    ("de", None, r"\b(Max|Moritz|Felix|Jonas|Lukas|Lea|Lena|Anna|Schmidt|Schneider|Weber|Meyer|Becker)\b"),
    ("fr", "[éèêëàâçîïôûù]", r"\b(Monsieur|Madame|Rue|Boulevard|Avenue|SARL|SAS)\b"),
    ("es", "[ñáéíóú]", r"\b(Señor|Señora|Calle|Avenida|Paseo|S\.L\.|SL)\b"),
    ("it", "[àèéìíîòóù]", r"\b(Signor|Signora|Via|Piazza|Corso|S\.r\.l\.|SpA)\b"),
    ("nl", None, r"\b(Dhr\.?|Mevr\.?|Mevrouw|Heer|Straat|Gracht|Plein|Laan|BV|NV|Nederland|Amsterdam|Rotterdam|Utrecht)\b"),
    ("nl", None, r"\b(Daan|Bram|Lars|Sanne|Lotte|Jansen|Bakker|Visser|Meijer|Mulder)\b"),
)
# Rules by which an address's country is guessed, in order: patterns without and with case.
COUNTRY_RULES = (
    ("de", (r"\b(Deutschland|Germany|DE)\b", r"\bStraße\b", r"\bStrasse\b"), ()),
    ("at", (r"\b(Österreich|Austria|AT)\b", r"\bWien\b"), ()),
    ("ch", (r"\b(Schweiz|Switzerland|Suisse|CH)\b", r"\bZürich\b"), ()),
    ("us", (r"\b(USA|United States|US)\b",), (r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b",)),
    ("uk", (r"\b(United Kingdom|UK)\b",), (r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",)),
    ("fr", (r"\b(France|FR)\b", r"\b(Rue|Boulevard|Avenue)\b"), ()),
    ("es", (r"\b(España|Spain|ES)\b", r"\b(Calle|Avenida|Paseo)\b"), ()),
    ("it", (r"\b(Italia|Italy|IT)\b", r"\b(Via|Piazza|Corso)\b"), ()),
    ("nl", (r"\b(Netherlands|Nederland|NL)\b",), (r"\b\d{4}\s?[A-Z]{2}\b",)),
)

# Triage limits, names and patterns (\b and \s stand for the ASCII boundary and WS until java() has replaced them).
BYPASS_CHARS = 600
BYPASS_LINES = 6
FIRST_NAMES = (
    "alex", "anna", "avery", "bram", "camille", "casey", "charlie", "chloe", "clara", "daan", "daniel", "david", "emily",
    "emma", "felix", "hanna", "hannah", "henry", "jack", "james", "jan", "jonas", "jordan", "julia", "kai", "kim", "laura",
    "lea", "lena", "leon", "lily", "lou", "lucas", "lukas", "marie", "max", "mia", "miles", "moritz", "noa", "noah",
    "oliver", "paul", "robin", "sam", "sarah", "simon", "sophie", "taylor", "thomas", "tim", "toni",
)
HONORIFIC = r"\b(?:herr|frau|mr\.?|mrs\.?|ms\.?|miss|dr\.?|prof\.?|monsieur|madame|señor|senor|señora|senora|signor|signora|dhr\.?|mevr\.?|mevrouw|heer)\b"
ADDRESS = r"\b(?:[A-ZÄÖÜ][\p{L}'’-]*\s+)?(?:straße|strasse|street|st\.|road|rd\.|avenue|ave\.|weg|allee|platz|gasse|boulevard|rue|via|calle|laan|straat)\b|\b\d{4,5}\s+[A-ZÄÖÜ][\p{L}'’-]+|\b\d{4}\s?[A-Z]{2}\s+[A-Z][\p{L}'’-]+|\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b"
COMPANY = r"\b[\p{L}0-9&.'’-]+\s+(?:GmbH(?:\s*&\s*Co\.\s*KG)?|UG\s*\(haftungsbeschränkt\)|AG|KG|OHG|LLC|Inc\.?|Ltd\.?|Corp\.?|Corporation|S\.?A\.?R\.?L\.?|SARL|SAS|S\.?L\.?|S\.?r\.?l\.?|SpA|BV|NV)\b"
ID_CONTEXT = r"\b(?:patient|kunde|kundin|customer|client|mandant|kontakt|contact|adresse|address|anschrift|vertrag|contract|rechnung|invoice|account|konto|policy|claim|case|ticket|dob|birth|birthday|born|geboren|geburtsdatum|passport|reisepass|ausweis|driver'?s?\s+license|führerschein|fuehrerschein|medical\s+record|krankenakte|versicherungsnummer|kundennummer|steuer(?:-|\s*)id|tax\s+id|ssn|national\s+id)\b"
ID_VALUE = r"\b(?:id|nr\.?|nummer|number|record)\s*[:#-]?\s*[A-Z0-9][A-Z0-9/-]{2,}\b"
LOW_RISK = (
    r"^(?:(?:please|kindly)\s+)?(?:summari[sz]e|translate|rewrite|explain|improve|shorten|proofread|format|fix|check)\b|^(?:can|could)\s+you\b.{0,120}\b(?:summari[sz]e|translate|rewrite|explain|improve|shorten|proofread|format|grammar|spelling)\b",
    r"^(?:bitte\s+)?(?:kurz\s+)?(?:zusammenfassen|übersetzen|uebersetzen|umformulieren|erklären|erklaeren|verbessern|korrigieren|kürzen|kuerzen|prüfen|pruefen)\b|^(?:kannst|könntest|koenntest)\s+du\b.{0,120}\b(?:zusammenfassen|übersetzen|uebersetzen|umformulieren|erklären|erklaeren|verbessern|korrigieren|kürzen|kuerzen|prüfen|pruefen)\b",
    r"^(?:hello|hi|hey|thanks|thank you|danke|ok|okay|ja|nein)\b",
)

# What a control that copies is called.
COPY_CONTROL = r"\b(copy|clipboard|kopieren|copiar|copier|copia|copie)\b|antwort\s+kopieren|copy\s+(response|answer)"

# Limits of chunking and of the model path.
CHUNK = {"fallback": 8000, "least": 1200, "most": 18000, "per_token": 4, "ratio": 0.65, "near": 0.85, "overlap": 160}
LONG_TEXT = 4000
COPY_WINDOW_MS = 2000
TTL_MINUTES = 30


def java(pattern: str) -> str:
    """A pattern written with \\b and \\s, with the ASCII boundary and JavaScript's white space in their place."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[:1] == "\\":
            out.append(B if two == r"\b" else (WS_CHARS if inside else WS) if two == r"\s" else two)
            i += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out.append(two[0])
        i += 1
    return "".join(out)
