"""Fixed values the results depend on: character classes, patterns, word lists and tables."""

# --- fixed values: character classes (written so that Java and RE2 read them alike) ---
WHITESPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WEB_WHITESPACE = r"\t-\r\x{20}\x{feff}\p{Z}"
WORD = r"\p{L}\p{N}_"
PROSE_KEPT = r"a-zA-Z0-9" + WHITESPACE + r".,\-/()@+"

# --- fixed values: personal-data grammar ---
ADDRESS = (
    r"(?i)\b\d{1,3}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}"
    r"(?:\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Way|"
    r"Ct|Court|Pl|Place|Pkwy|Parkway|Hwy|Highway|Cir|Circle|Terrace|Ter)\.?)?"
    r"(?:[,\s]+(?:Apt|Apartment|Suite|Ste|Unit|Fl|Floor|#)\s*[\w-]+)?"
)
PHONE_INTERNATIONAL = (
    r"(?:\+|00)\d{1,3}[\s\-.]?(?:\(?\d{1,4}\)?[\s\-.]?)?\d{1,4}[\s\-.]?\d{1,4}[\s\-.]?\d{1,9}"
)
PHONE_THREE_THREE_FOUR = r"\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}"
PHONE_FIVE_THREE = r"\d{5}[\s\-.]?\d{3}[\s\-.]?\d{2,3}"
PHONE_BETWEEN_SLASHES = (
    r"/(?:\+{0,1}\d+)(?:\s+|-)\({0,1}\d{1,3}\({0,1}(?:(?:\s*|-|\()\d{2,5}(?:\){0,1})\s*?){1,3}/"
)
ZIP = r"\b\d{5}(?:-\d{4})?\b|\b\d{6}\b"
POBOX = r"(?i)\bP\.?\s*O\.?\s*Box\s+\d+\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"

# entity labels that are redacted by default
PII_LABELS = ["PERSON", "GPE", "LOC"]
# labels of model-found entities that count as skills, and the score they need
SKILL_LABELS = ["skill", "software", "technical concept"]
ENTITY_THRESHOLD = 0.5

# --- fixed values: stop list of the keyword score ---
KEYWORD_STOP_WORDS = [
    "the", "and", "a", "to", "of", "in", "for", "is", "on", "that", "by", "this", "with", "i", "you", "it",
    "not", "or", "be", "are", "from", "at", "as", "your", "all", "have", "new", "more", "an", "was", "we",
    "will", "can", "us", "about", "if", "my", "has", "but", "our", "one", "other", "do", "no", "they", "he",
    "up", "may", "what", "which", "their", "out", "use", "any", "there", "see", "only", "so", "his", "when",
    "who", "also", "now", "get",
]

# --- fixed values: match bands ---
GREAT_MATCH_SCORE = 70
GREAT_MATCH_TEXT = "Great match! Your resume aligns well with this role."
ADVICE_TEXT = "Consider adding more keywords from the job description to your resume."

# --- fixed values: raw resume category -> broad category ---
CATEGORY_PAIRS = [
    ("Electrical Engineering", "Engineering"),
    ("Mechanical Engineer", "Engineering"),
    ("Civil Engineer", "Engineering"),
    ("Architecture", "Engineering"),
    ("Java Developer", "Technology"),
    ("Python Developer", "Technology"),
    ("React Developer", "Technology"),
    ("DotNet Developer", "Technology"),
    ("SAP Developer", "Technology"),
    ("ETL Developer", "Technology"),
    ("SQL Developer", "Technology"),
    ("DevOps", "Technology"),
    ("Database", "Technology"),
    ("Network Security Engineer", "Technology"),
    ("Information Technology", "Technology"),
    ("Web Designing", "Technology"),
    ("Blockchain", "Technology"),
    ("Data Science", "Technology"),
    ("Testing", "Technology"),
    ("Management", "Business & Management"),
    ("Consultant", "Business & Management"),
    ("Business Analyst", "Business & Management"),
    ("Operations Manager", "Business & Management"),
    ("PMO", "Business & Management"),
    ("BPO", "Business & Management"),
    ("Accountant", "Finance & Accounting"),
    ("Finance", "Finance & Accounting"),
    ("Banking", "Finance & Accounting"),
    ("Sales", "Sales & Marketing"),
    ("Public Relations", "Sales & Marketing"),
    ("Digital Media", "Sales & Marketing"),
    ("Human Resources", "Human & Social Services"),
    ("Education", "Human & Social Services"),
    ("Advocate", "Human & Social Services"),
    ("Arts", "Creative & Design"),
    ("Designing", "Creative & Design"),
    ("Apparel", "Creative & Design"),
    ("Health and Fitness", "Health & Lifestyle"),
    ("Food and Beverages", "Health & Lifestyle"),
    ("Automobile", "Automobile"),
    ("Aviation", "Aviation & Transport"),
    ("Agriculture", "Agriculture"),
    ("Building and Construction", "Building & Construction"),
]

# --- fixed values: the text document of a job ---
DESCRIPTION_DIR = "job_descriptions"
DESCRIPTION_LABELS = {
    "title": "Title          : ",
    "company": "Company        : ",
    "location": "Location       : ",
    "matched_skills": "Matched Skills : ",
}
NO_SKILLS = "None"
DESCRIPTION_RULE = "─" * 60

# --- fixed values: upload types ---
ACCEPTED_TYPES = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
READABLE_TYPES = [ACCEPTED_TYPES["pdf"], ACCEPTED_TYPES["docx"]]

# --- fixed values: split and vectoriser settings ---
SEED = 420
TEST_SHARE = 0.3
FOLDS = 5
