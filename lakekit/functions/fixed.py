"""Word lists, patterns and limits that the results depend on.

These must stay exactly as they are for results to match; change nothing here
without changing the expected answers.
"""

# File suffixes counted as data files.
DATA_SUFFIXES = [".json", ".csv", ".xml", ".db", ".sqlite", ".parquet", ".feather", ".arrow", ".avro"]

# File suffixes with a text preview.
PREVIEW_SUFFIXES = [".csv", ".json", ".md", ".txt", ".py", ".xml", ".yml", ".yaml"]

# File names that count as API documentation.
API_DOC_NAMES = ["swagger.json", "openapi.yaml", "openapi.yml", "openapi.json"]

# A README that mentions an API.
README_API_REGEXES = [r"https?://[^\s]*api[^\s]*", r"/api/v?\d", r"endpoint", r"REST\s*API", r"GraphQL"]

# README file names in order of preference.
README_NAMES = ["README.md", "README.rst", "README.txt", "README"]

# License file names in order of preference.
LICENSE_NAMES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING"]

# Characters of a license file that are searched.
LICENSE_HEAD_CHARS = 2000

# License texts; the first kind with a matching pattern wins.
LICENSE_REGEXES = {
    "MIT": [r"MIT\s+License", r"Permission is hereby granted, free of charge"],
    "Apache 2.0": [r"Apache\s+License.*2\.0", r"Licensed under the Apache License"],
    "GPL": [r"GNU GENERAL PUBLIC LICENSE", r"GPLv[23]"],
    "CC0": [r"CC0\s+1\.0", r"Creative Commons Zero", r"dedicate.*public domain"],
    "BSD": [r"BSD\s+License", r"Redistribution and use in source and binary forms"],
}

# Words in a column name that suggest personal data.
PII_WORDS = {
    "email": ["email", "e-mail", "email_address", "contact_email"],
    "phone": ["phone", "telephone", "cell", "mobile", "contact_number", "phone_number"],
    "address": ["address", "street", "city", "state", "zip", "postal", "location", "residence"],
    "name": ["first_name", "last_name", "full_name", "given_name", "surname", "middle_name"],
    "ssn": ["ssn", "social_security", "national_id", "tax_id"],
    "ip": ["ip_address", "ip_addr", "client_ip", "remote_addr"],
}

# Words in a search that ask for a data type, or for API documentation.
TYPE_INTENTS = {
    ".csv": ["csv", "comma-separated", "tabular"],
    ".json": ["json"],
    ".xml": ["xml"],
    ".db": ["database", "db", "sqlite"],
}
API_INTENT = ["api", "rest", "endpoint", "swagger", "openapi"]

# Folder of a data file in the flat layout, by suffix.
FLAT_FOLDERS = {".json": "json", ".csv": "csv", ".xml": "xml", ".db": "db", ".sqlite": "db"}
FLAT_OTHER = "unstructured/raw"

# Suffixes of links that point to data.
DATA_LINK_SUFFIXES = [".csv", ".json", ".xml", ".parquet", ".zip", ".gz"]

# Path parts that mark a link as no project link.
NON_PROJECT_PARTS = ["search", "login", "explore", "notifications"]

# Words that mark a statement as writing.
WRITE_WORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE"]

# Further words refused by the strict gate.
STRICT_WORDS = WRITE_WORDS + ["COPY", "ATTACH", "MERGE", "REPLACE", "SET", "LOAD", "ADD", "CACHE"]

# Words in a question that ask for a trend.
TREND_WORDS = ["趋势", "时间"]
TREND_WORD_ANY_CASE = "trend"

# Name starts that mark a project as having samples.
SAMPLE_NAME_STARTS = ["sample", "example", "test", "demo", "data"]

# Health score of an entity.
HEALTH_START = 10.0
HEALTH_MAX = 20.0
HEALTH_MIN = 0.0
HEALTH_GAIN = 0.5
HEALTH_LOSS = 2.0
HEALTH_ALIVE = 1.0
