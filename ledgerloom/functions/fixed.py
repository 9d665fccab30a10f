"""Names, labels, patterns and formats that results depend on.

Everything here is data. The regions' districts and the industry tree are larger than that
and come as tables (see ``ledgerloom.sources.dimensions``).
"""

# fixed values: provinces and their spellings
PROVINCES = {
    "서울특별시": ["서울", "서울시", "서울특별시"],
    "부산광역시": ["부산", "부산시", "부산광역시"],
    "대구광역시": ["대구", "대구시", "대구광역시"],
    "인천광역시": ["인천", "인천시", "인천광역시"],
    "광주광역시": ["광주", "광주시", "광주광역시"],
    "대전광역시": ["대전", "대전시", "대전광역시"],
    "울산광역시": ["울산", "울산시", "울산광역시"],
    "세종특별자치시": ["세종", "세종시", "세종특별자치시"],
    "경기도": ["경기", "경기도"],
    "강원특별자치도": ["강원", "강원도", "강원특별자치도"],
    "충청북도": ["충북", "충청북도"],
    "충청남도": ["충남", "충청남도"],
    "전북특별자치도": ["전북", "전라북도", "전북특별자치도"],
    "전라남도": ["전남", "전라남도"],
    "경상북도": ["경북", "경상북도"],
    "경상남도": ["경남", "경상남도"],
    "제주특별자치도": ["제주", "제주도", "제주특별자치도"],
}

# fixed values: words of company names that don't count, listed markets, auditors' words
COMPANY_WORDS = ["주식회사", "(주)", "(유)", "유한회사"]
LISTED_MARKETS = ["유가증권시장", "코스닥시장", "코넥스시장"]
AUDITOR_SUFFIXES = ["회계법인", "감사반"]
SIGNER_WORDS = ["대표이사", "대표자", "사원"]

# fixed values: kinds of audit opinions in the order in which they are decided, and their patterns
OPINIONS = {
    "의견거절": r"의견거절|의견을\s*표명하지\s*않습니다",
    "부적정": r"부적정|(?:공정|적정)하게\s*표시하고\s*있지\s*않습니다",
    "한정": r"한정\s*의견|제외하고는[\s\S]{0,120}?(?:공정|적정)하게\s*표시하고\s*있습니다",
    "적정": r"(?:공정|적정)하게\s*표시하고\s*있습니다",
}
OPINION_WINDOW = 4000
UNRELIABLE_OPINIONS = ["의견거절", "부적정"]
UNKNOWN_OPINION = "미상"

# fixed values: the items of the statements
STANDARD_ITEMS = [
    "current_assets", "noncurrent_assets", "total_assets", "current_liab", "noncurrent_liab", "total_liab", "total_equity",
    "revenue", "cogs", "gross_profit", "sga", "operating_income", "net_income",
]
CASH_FLOW_ITEMS = ["cf_operating", "cf_investing", "cf_financing", "cf_ending_cash"]
NON_OPERATING_ITEMS = ["non_operating_income", "non_operating_expense"]
DETAIL_ITEMS = ["cash_and_equivalents", "trade_receivables", "interest_expense", "depreciation", "amortization"]
ITEMS = STANDARD_ITEMS + CASH_FLOW_ITEMS + NON_OPERATING_ITEMS + DETAIL_ITEMS

# fixed values: statements with their items in the order of exports
STATEMENTS = {
    "재무상태표": {
        "current_assets": "유동자산",
        "noncurrent_assets": "비유동자산",
        "total_assets": "자산총계",
        "current_liab": "유동부채",
        "noncurrent_liab": "비유동부채",
        "total_liab": "부채총계",
        "total_equity": "자본총계",
        "cash_and_equivalents": "현금및현금성자산(순액)",
        "trade_receivables": "매출채권(순액)",
    },
    "손익계산서": {
        "revenue": "매출액",
        "cogs": "매출원가",
        "gross_profit": "매출총이익",
        "sga": "판매비와관리비",
        "operating_income": "영업이익",
        "net_income": "당기순이익",
        "non_operating_income": "영업외수익",
        "non_operating_expense": "영업외비용",
        "interest_expense": "이자비용",
    },
    "현금흐름표": {
        "cf_operating": "영업활동현금흐름",
        "cf_investing": "투자활동현금흐름",
        "cf_financing": "재무활동현금흐름",
        "cf_ending_cash": "기말의현금",
        "depreciation": "감가상각비(현금흐름표)",
        "amortization": "무형자산상각비",
    },
}

# fixed values: the order of items in a selection's long sheet
SELECTION_ITEMS = [
    "current_assets", "noncurrent_assets", "total_assets", "current_liab", "noncurrent_liab", "total_liab", "total_equity",
    "cash_and_equivalents", "trade_receivables",
    "revenue", "cogs", "gross_profit", "sga", "operating_income", "net_income", "interest_expense",
    "cf_operating", "cf_investing", "cf_financing", "cf_ending_cash", "depreciation", "amortization",
    "non_operating_income", "non_operating_expense",
]

# fixed values: account labels (normalised) of balance sheet and income statement
ACCOUNT_LABELS = {
    "유동자산": "current_assets",
    "비유동자산": "noncurrent_assets",
    "자산총계": "total_assets",
    "유동부채": "current_liab",
    "비유동부채": "noncurrent_liab",
    "부채총계": "total_liab",
    "자본총계": "total_equity",
    "유동자산합계": "current_assets",
    "비유동자산합계": "noncurrent_assets",
    "유동부채합계": "current_liab",
    "비유동부채합계": "noncurrent_liab",
    "유동자산계": "current_assets",
    "비유동자산계": "noncurrent_assets",
    "유동부채계": "current_liab",
    "비유동부채계": "noncurrent_liab",
    "매출액": "revenue",
    "매출액및영업수익": "revenue",
    "영업수익": "revenue",
    "수익(매출액)": "revenue",
    "매출": "revenue",
    "매출원가": "cogs",
    "매출총이익": "gross_profit",
    "매출총손실": "gross_profit",
    "매출총이익(손실)": "gross_profit",
    "매출총이익(총손실)": "gross_profit",
    "매출총손실(이익)": "gross_profit",
    "판매비와관리비": "sga",
    "영업이익": "operating_income",
    "영업손실": "operating_income",
    "영업이익(손실)": "operating_income",
    "영업이익(영업손실)": "operating_income",
    "영업손실(이익)": "operating_income",
    "당기순이익": "net_income",
    "당기순손실": "net_income",
    "당기순이익(손실)": "net_income",
    "당기순이익(순손실)": "net_income",
    "당기순손실(이익)": "net_income",
    "연결당기순이익": "net_income",
    "연결당기순손실": "net_income",
    "연결당기순이익(손실)": "net_income",
    "연결당기순이익(순손실)": "net_income",
    "당기순손익": "net_income",
    "당기연결순이익": "net_income",
    "당기연결순손실": "net_income",
    "당기연결순이익(손실)": "net_income",
    "연결당기순손익": "net_income",
    "영업외수익": "non_operating_income",
    "영업외비용": "non_operating_expense",
}

# fixed values: labels of the cash-flow statement
CASH_FLOW_LABELS = {
    "영업활동으로인한현금흐름": "cf_operating",
    "영업활동현금흐름": "cf_operating",
    "영업활동으로부터의현금흐름": "cf_operating",
    "영업활동순현금흐름": "cf_operating",
    "투자활동으로인한현금흐름": "cf_investing",
    "투자활동현금흐름": "cf_investing",
    "투자활동으로부터의현금흐름": "cf_investing",
    "투자활동순현금흐름": "cf_investing",
    "재무활동으로인한현금흐름": "cf_financing",
    "재무활동현금흐름": "cf_financing",
    "재무활동으로부터의현금흐름": "cf_financing",
    "재무활동순현금흐름": "cf_financing",
    "기말의현금": "cf_ending_cash",
    "기말현금": "cf_ending_cash",
    "기말의현금및현금성자산": "cf_ending_cash",
    "기말현금및현금성자산": "cf_ending_cash",
}

# fixed values: labels of detail accounts; the same label means different things by statement
DETAIL_LABELS = {
    "bs": {
        "현금및현금성자산": "cash_and_equivalents",
        "현금및현금등가물": "cash_and_equivalents",
        "현금및예치금": "cash_and_equivalents",
        "현금성자산": "cash_and_equivalents",
        "매출채권": "trade_receivables",
        "유동매출채권": "trade_receivables",
        "단기매출채권": "trade_receivables",
    },
    "is": {"이자비용": "interest_expense", "지급이자": "interest_expense"},
    "cf": {
        "감가상각비": "depreciation",
        "유형자산감가상각비": "depreciation",
        "무형자산상각비": "amortization",
        "무형자산상각": "amortization",
        "무형고정자산상각": "amortization",
        "무형고정자산상각비": "amortization",
        "무형자산감가상각비": "amortization",
    },
}

# fixed values: rows that are subtracted from the item above them: markers, and the owner's word
CONTRA_ROWS = {
    "trade_receivables": (["대손충당금", "대손충당부채", "대손충담금", "대손충당"], "매출채권"),
    "cash_and_equivalents": (["정부보조금", "국고보조금", "정부조보금", "국고보고조금"], "현금"),
}

# fixed values: numbering before labels and remarks behind them
ROMAN = ["VIII", "XII", "III", "VII", "XI", "IV", "VI", "IX", "II", "I", "V", "X"]
LABEL_PREFIX = rf"^\s*(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ∥]+\s*\.?|(?:{'|'.join(ROMAN)})\.|\d+\.|\([0-9]+\)|[가-힣]\.)\s*"
ROMAN_PREFIX = rf"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ∥]+|(?:{'|'.join(ROMAN)}))\s*\."
LOOKALIKE_PREFIX = r"^\s*([IlivVXΙⅠ]+)\s*\."
LOOKALIKES = ("liΙⅠ", "IIII")
PER_SHARE_SUFFIX = r"\(\s*주당[^()]*(?:\([^()]*\)[^()]*)*\)+\s*$"
FOOTNOTE_SUFFIX = r"\(\s*(?:(?:주석|주)[\s0-9,과와]*|[\s0-9,]*)\)\s*$"
FORMULA_SUFFIX = r"[\(\[][ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩIVX0-9\s+＋]+[\)\]]\s*$"
SUBITEM_PREFIX = r"^(?:\d+\s*[.)]|\([0-9]+\)|[가-힣]\s*\.)"
ORDINAL_PERIOD = r"제\d+(?:\([당전]\))?기"
XML_DECLARATION = r"^\s*<\?xml[^>]*\?>"
PSEUDO_TAG = r"</?[가-힣][^<>]*>"
LABEL_BLANKS = " 　\n\r\t"
ZERO_AMOUNTS = ["-", "−", "‐", "–"]
RULE_CHARS = "=＝"

# fixed values: warnings of reports
WARNING_NAMES = 3
YEAR_SUFFIX = "년"
MORE_NAMES = (" 외 ", "곳")
CONTACT_PLACEHOLDER = "연락처 미입력"
