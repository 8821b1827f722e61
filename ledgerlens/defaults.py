"""Default rule data for cleaning and categorising statement rows.

Every operator in this package takes its rules as a parameter; these are only the defaults.

FIXED VALUES
------------
The lists below must equal the source application's defaults for results to agree with it.
They are stated as plain text, in their original order, and kept together in this one place.
Order matters everywhere: every list is evaluated first-match-wins.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: merchant-name cleaning
# ---------------------------------------------------------------------------------------------

# Literal tokens removed anywhere in the merchant name, in this order (each has a leading blank).
NOISE_TOKENS: list[str] = [
    " SINGAPORE", " PTE LTD", " SDN BHD", " LTD", " (S)",
    " PVT", " PRIVATE", " HOLDINGS", " INTERNATIONAL", " GROUP",
]

# Alias map: the first alias contained in the cleaned name replaces the whole name.
MERCHANT_ALIASES: list[tuple[str, str]] = [
    ("GRAB FOOD", "GRAB FOOD"),
    ("GRAB*FOOD", "GRAB FOOD"),
    ("GRABFOOD", "GRAB FOOD"),
    ("GRAB CAR", "GRAB TRANSPORT"),
    ("GRAB TAXI", "GRAB TRANSPORT"),
    ("GRAB RIDE", "GRAB TRANSPORT"),
    ("MCDONALDS", "MCDONALD'S"),
    ("MCDONALD S", "MCDONALD'S"),
    ("COMFORTDELGRO", "COMFORT DELGRO"),
    ("COMFORT TAXI", "COMFORT DELGRO"),
    ("CDG TAXI", "COMFORT DELGRO"),
    ("SP SERVICES", "SINGAPORE POWER"),
    ("SP GROUP", "SINGAPORE POWER"),
    ("NTUC FAIRPRICE", "FAIRPRICE"),
    ("FAIRPRICE XTRA", "FAIRPRICE"),
    ("FAIRPRICE FINEST", "FAIRPRICE"),
    ("APPLE COM BILL", "APPLE.COM"),
    ("APPLE.COM/BILL", "APPLE.COM"),
]

# Regular-expression patterns of the cleaning steps (Java syntax; `(?U)` is added by the caller).
TERMINAL_SUFFIX_RE = r"\s+(SI )?SGP\s+\d{2}[A-Z]{3}.*$"
GRAB_PREFIX_RE = r"^GRAB\*\s*(GPC-)?[A-F0-9]+\s*"
GRAB_PREFIX_REPLACEMENT = "GRAB "
LITERAL_REWRITES: list[tuple[str, str]] = [
    ("FP*FOOD PANDA", "FOOD PANDA"),
    ("GOOGLE*YOUTUBEPREMIUM", "YOUTUBE PREMIUM"),
]
COUNTRY_SUFFIX_RE = r"\s+SG\s*$"
LEADING_DIGITS_RE = r"^\d{5,}\s+"
REFERENCE_TAIL_RE = r"[*#]\S*"
WHITESPACE_RUN_RE = r"\s{2,}"
MERCHANT_MAX_CHARS = 45

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: transaction-code sets used by the category cascade
# ---------------------------------------------------------------------------------------------

GENERIC_CODES: list[str] = ["MST", "POS", "NETS", "BAT", "DEP", "WDL", "AWL", "CCCC"]
BIDIRECTIONAL_CODES: list[str] = ["ICT", "GR", "GRP", "GRS", "GRC", "GRB", "IBG", "DCR", "DCRT", "PAY"]
CASH_CODES: list[str] = ["AWL", "WDL", "NWL", "C-WDL", "ATM"]

CASH_CATEGORY = "Cash Withdrawals"
INCOME_CATEGORY = "Income"
OUTBOUND_CATEGORY = "PayNow & FAST"
UNCATEGORISED = "Uncategorised"
UNKNOWN_PAYEE = "UNKNOWN PAYEE"

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: merchant keyword map (matched on the lower-cased description, first hit wins)
# ---------------------------------------------------------------------------------------------

MERCHANT_KEYWORDS: list[tuple[str, str]] = [
    # Food & Drink
    ("grab food", "Food & Drink"), ("grabfood", "Food & Drink"), ("food panda", "Food & Drink"),
    ("foodpanda", "Food & Drink"), ("fp*food panda", "Food & Drink"), ("deliveroo", "Food & Drink"),
    ("mcdonald", "Food & Drink"), ("fairprice", "Food & Drink"), ("sheng siong", "Food & Drink"),
    ("cold storage", "Food & Drink"), ("giant", "Food & Drink"), ("kopitiam", "Food & Drink"),
    ("hawker", "Food & Drink"), ("starbucks", "Food & Drink"), ("toast box", "Food & Drink"),
    ("ya kun", "Food & Drink"), ("old chang kee", "Food & Drink"), ("bengawan", "Food & Drink"),
    ("prima deli", "Food & Drink"), ("bread talk", "Food & Drink"), ("4fingers", "Food & Drink"),
    ("jollibee", "Food & Drink"), ("subway", "Food & Drink"), ("burger king", "Food & Drink"),
    ("kfc", "Food & Drink"), ("pizza", "Food & Drink"), ("dining", "Food & Drink"),
    ("restaurant", "Food & Drink"), ("cafe", "Food & Drink"), ("bakery", "Food & Drink"),
    ("yqueue", "Food & Drink"), ("dabba street", "Food & Drink"), ("wingstop", "Food & Drink"),
    ("shiok burger", "Food & Drink"), ("chagee", "Food & Drink"), ("supersnacks", "Food & Drink"),
    ("stuff'd", "Food & Drink"), ("coffee", "Food & Drink"), ("beviamo", "Food & Drink"),
    ("f&b", "Food & Drink"),
    # Subscriptions
    ("spotify", "Subscriptions"), ("netflix", "Subscriptions"), ("apple.com/bill", "Subscriptions"),
    ("apple.com", "Subscriptions"), ("google play", "Subscriptions"), ("amazon prime", "Subscriptions"),
    ("amznprimesg", "Subscriptions"), ("disney+", "Subscriptions"), ("disneyplus", "Subscriptions"),
    ("youtubepremium", "Subscriptions"), ("youtube", "Subscriptions"), ("google*youtube", "Subscriptions"),
    ("microsoft 365", "Subscriptions"), ("adobe", "Subscriptions"), ("chatgpt", "Subscriptions"),
    ("openai", "Subscriptions"), ("notion", "Subscriptions"), ("dropbox", "Subscriptions"),
    ("icloud", "Subscriptions"), ("subscriptiongrab", "Subscriptions"), ("grab subscription", "Subscriptions"),
    # Transport
    ("grab transport", "Transport"), ("grab car", "Transport"), ("grab taxi", "Transport"),
    ("grab ride", "Transport"), ("grabpay-ec", "Transport"), ("grab", "Transport"),
    ("comfort", "Transport"), ("comfortdelgro", "Transport"), ("cdg", "Transport"),
    ("gojek", "Transport"), ("uber", "Transport"), ("transit link", "Transport"),
    ("transitlink", "Transport"), ("ez-link", "Transport"), ("smrt", "Transport"),
    ("sbst", "Transport"), ("sbs transit", "Transport"), ("parking", "Transport"),
    ("car park", "Transport"), ("esso", "Transport"), ("shell", "Transport"),
    ("caltex", "Transport"), ("spc", "Transport"), ("koolex", "Transport"),
    ("tada", "Transport"), ("ryde", "Transport"), ("phv", "Transport"),
    # Health & Wellness
    ("watsons", "Health & Wellness"), ("guardian", "Health & Wellness"), ("unity pharmacy", "Health & Wellness"),
    ("ntuc unity", "Health & Wellness"), ("polyclinic", "Health & Wellness"), ("hospital", "Health & Wellness"),
    ("dental", "Health & Wellness"), ("clinic", "Health & Wellness"), ("physiotherapy", "Health & Wellness"),
    ("optometrist", "Health & Wellness"), ("eyecare", "Health & Wellness"), ("gym", "Health & Wellness"),
    ("fitness", "Health & Wellness"), ("anytime fitness", "Health & Wellness"), ("pure fitness", "Health & Wellness"),
    ("activesg", "Health & Wellness"), ("hockhua", "Health & Wellness"),
    # Utilities
    ("singapore power", "Utilities"), ("sp services", "Utilities"), ("sp group", "Utilities"),
    ("starhub", "Utilities"), ("singtel", "Utilities"), ("m1 limited", "Utilities"),
    ("myrepublic", "Utilities"), ("viewqwest", "Utilities"), ("pub ", "Utilities"),
    # Shopping
    ("ikea", "Shopping"), ("uniqlo", "Shopping"), ("zara", "Shopping"),
    ("h&m", "Shopping"), ("lazada", "Shopping"), ("shopee", "Shopping"),
    ("amazon", "Shopping"), ("courts", "Shopping"), ("harvey norman", "Shopping"),
    ("best denki", "Shopping"), ("challenger", "Shopping"), ("wristcheck", "Shopping"),
    ("taobao", "Shopping"), ("shein", "Shopping"), ("aliexpress", "Shopping"),
    # Entertainment
    ("cathay", "Entertainment"), ("golden village", "Entertainment"), ("gv ", "Entertainment"),
    ("shaw", "Entertainment"), ("sports hub", "Entertainment"), ("escape", "Entertainment"),
    ("laser quest", "Entertainment"), ("bowling", "Entertainment"), ("ktv", "Entertainment"),
    ("karaoke", "Entertainment"), ("have fun", "Entertainment"),
    # Education
    ("nus", "Education"), ("ntu", "Education"), ("smu", "Education"),
    ("sit ", "Education"), ("sutd", "Education"), ("kaplan", "Education"),
    ("school fee", "Education"), ("tuition", "Education"), ("coursera", "Education"),
    ("udemy", "Education"), ("skillsfuture", "Education"),
    # Investments
    ("interactive brokers", "Investments"),
    # Transfers
    ("top-up to paylah!", "Transfers"),
    # Income
    ("salary credit", "Income"), ("payroll", "Income"),
]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: code-description rules (lower-cased substring, any keyword of a group, first group wins)
# ---------------------------------------------------------------------------------------------

CODE_RULES: list[tuple[list[str], str]] = [
    (["salary", "payroll", "pay credit"], "Income"),
    (["dividend", "dividends payment", "dividends/cash"], "Income"),
    (["interest earned", "bonus interest", "credit interest",
      "interest on mma", "total interest", "top up interest",
      "fixed deposit interest", "savings reward", "cashback bonus",
      "workfare", "silver support", "baby bonus", "growth dividend",
      "government payout", "gst voucher", "gstv", "saye cash gift",
      "saye account", "special reward", "cash-point incentive",
      "inward remittance", "cpf profit transfer",
      "guaranteed notes issuance"], "Income"),
    (["payroll", "giro payroll", "salary credit",
      "inward fast", "fast receipt",
      "instant direct credit"], "Income"),
    (["funds transfer", "fund transfer", "telegraphic transfer",
      "fast payment", "fast or paynow", "fast receipt",
      "paynow", "interbank", "giro", "instant direct credit",
      "instant direct debit", "meps payment", "meps receipt",
      "remittance", "cancellation transfer", "creation transfer",
      "returned interbank", "standing instruction",
      "cash withdrawal", "atm transaction", "cash deposit",
      "regional funds", "outward demand draft", "inward demand draft",
      "cashier's order", "reversal", "returned cheque", "returned giro",
      "cheque writing", "cheque"], "Transfers"),
    (["service charge", "annual fee", "monthly account fee",
      "debit card annual fee", "atm withdrawal fee",
      "debit card replacement", "debit card retrieval",
      "coin deposit fee", "cheque book fee", "cheque fee",
      "commitment fee", "processing fee", "repricing fee",
      "flash pay fee", "custody", "custodian",
      "interest statement fee", "admin", "administrative charge",
      "overdraft interest", "revolving credit",
      "short term advance", "overdraft"], "Banking Fees"),
    (["unit trust", "fixed deposit", "structured deposit",
      "singapore government securities", "sgs", "shares",
      "share transaction", "share financing", "share application",
      "ipo", "purchase / sale of shares", "purchase international",
      "leverage currency", "hedging", "investment of funds",
      "bonds", "rights", "dividends payment", "dividend claim",
      "redemption of units", "savings bond", "cpf investment",
      "nets proceeds", "cashcard proceeds"], "Investments"),
    (["housing loan", "mortgage loan", "renovation loan",
      "personal loan", "term loan", "short term loan",
      "revolving advance", "computer loan", "study loan",
      "tuition fee loan", "club membership loan",
      "share financing loan", "car financing",
      "hire purchase", "bill payment to dbs mortgage",
      "bill payment to dbs cashline", "staff"], "Loans & Mortgage"),
    (["central provident fund", "cpf", "iras", "income tax",
      "property tax", "gst", "customs", "mas",
      "hdb", "housing & development board",
      "lta", "ura", "psa", "jtc", "public works",
      "ministry", "inland revenue", "monetary authority",
      "immigration", "cpf minimum sum"], "Government & CPF"),
    (["sp services", "power supply", "singapore power",
      "starhub", "singtel", "singapore telecom", "m1 limited",
      "pub", "public utilities", "keppel electric",
      "seraya energy", "geneco", "pager", "handphone",
      "mobilelink", "pagelink"], "Utilities"),
    (["hospital", "medical", "dental", "health",
      "polyclinic", "eye centre", "cancer centre",
      "nursing", "pharmacy", "institute of mental",
      "kkh", "sgh", "nuh", "ttsh", "nhg",
      "khoo teck puat", "changi general", "sengkang general",
      "national university hospital", "assisi hospice",
      "dover park hospice"], "Health & Wellness"),
    (["insurance", "prudential", "great eastern",
      "aia", "manulife", "tokio marine", "china taiping",
      "loanshield", "fire insurance", "travellershield",
      "life insurance", "general insurance"], "Insurance"),
    (["school", "university", "college", "education",
      "study", "tuition", "ntu", "nus", "smu",
      "kaplan", "nafa", "laselle", "james cook",
      "management development", "further studyassist",
      "scholarship"], "Education"),
    (["donation", "donate", "charity", "hospice",
      "nkf", "sinda", "mendaki", "self-help",
      "yellow ribbon", "rainbow", "touch community",
      "spd", "arc(s)", "leukemia", "cerebal palsy",
      "world vision", "red cross"], "Donations"),
    (["taxi", "grab", "transit", "mrt", "ez-link",
      "transitlink", "comfort delgro", "bus", "lta coe",
      "uber", "gojek", "cabcharge", "vehicle",
      "car financing", "car lease", "petrol",
      "petroleum", "esso", "shell", "caltex", "spc",
      "7-eleven"], "Transport"),
    (["food panda", "foodpanda", "delivery hero",
      "mcdonald", "macdonalds", "sheng siong",
      "ntuc fairprice", "fairprice", "cold storage",
      "kopitiam", "hawker"], "Food & Drink"),
    (["point-of-sale", "point of sale", "nets", "debit card transaction",
      "e-commerce", "purchase", "cirrus purchase",
      "ikea", "isetan", "duty free", "aldo",
      "cash converters", "gnc"], "Shopping"),
    (["club", "country club", "golf", "racing",
      "singapore pools", "turf club", "cable vision",
      "tickets", "entertainment"], "Entertainment"),
    (["magazine", "newspaper", "subscription",
      "standing instruction", "recurring"], "Subscriptions"),
]

# Code-list file: the two optional header lines.
CODE_LIST_HEADER_PREFIX = "transaction code"
CODE_LIST_SECOND_HEADER = "explanation"

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: categories and dashboard view settings
# ---------------------------------------------------------------------------------------------

SEEDED_CATEGORIES: list[str] = [
    "Food & Drink", "Transport", "Subscriptions", "Health & Wellness", "Shopping",
    "Utilities", "Entertainment", "Transfers", "PayNow & FAST", "Cash Withdrawals",
    "Internal Transfers", "Income", "Banking Fees", "Investments", "Education",
    "Insurance", "Donations", "Loans & Mortgage", "Government & CPF", "Uncategorised",
]

# Left out of the default budget table.
EXCLUDE_FROM_SPEND: list[str] = [
    "Income", "Transfers", "PayNow & FAST", "Cash Withdrawals", "Internal Transfers",
]

# Dropped from the expense view unless transfers are shown.
TRANSFER_TYPE_CATEGORIES: list[str] = [
    "Transfers", "PayNow & FAST", "Cash Withdrawals", "Internal Transfers",
]

# Statement CSV header names and the names used inside this package.
STATEMENT_COLUMNS: dict[str, str] = {
    "Transaction Date": "transaction_date",
    "Description": "description",
    "Withdrawal Amount": "withdrawal",
    "Deposit Amount": "deposit",
    "Transaction Code": "transaction_code",
}

# Display names of the transaction log.
LOG_COLUMNS: list[tuple[str, str]] = [
    ("transaction_date", "Date"),
    ("amount", "Amount (SGD)"),
    ("transaction_code", "Code"),
    ("merchant", "Merchant"),
    ("category", "Category"),
    ("description", "Description"),
]

# Budget chart metric labels.
METRIC_LABELS: dict[str, str] = {"spent": "Actual Spend", "monthly_limit": "Budget Limit"}

TOP_MERCHANTS_N = 12
