"""Word lists, patterns, labels and thresholds that define results.

Changing one changes what is computed, so they are kept together and written as
plain text.  Patterns use Java regular-expression syntax.
"""

# --- thresholds ------------------------------------------------------------
TIME_ZONE = "Asia/Hong_Kong"
MISSING_AFTER = 3              # complete listings without the id before "missing"
DROP_KEEP_RATIO = 0.4          # a list below 40 % of the last accepted one is untrusted
DROP_MIN_COUNT = 5             # ... but only when that one had at least five rows
STALE_AFTER_HOURS = 36
FEED_DAYS = 30                 # public feed, today included
DETAIL_TTL_MIN, DETAIL_TTL_MAX = 1, 7
DETAIL_NEAR_CLOSING_DAYS = 3
FAILURE_STOP = 3               # consecutive detail failures that stop a source
REQUEST_BUDGET = 400
ERRORS_KEPT = 8
DIGEST_LIMIT = 1740            # characters of a digest before the "N more" line
MESSAGE_LIMIT = 1900
FRAGMENT_LIMIT = 450
SNIPPET_LIMIT = 300
PART_TIME_KINDS = ("part-time", "hourly", "mixed")
WEAK_DEADLINES = ("unknown", "screening-or-closing")
SILENT_CAPABILITIES = ("manual", "pending")

# --- rule dictionary -------------------------------------------------------
MIN_SCORE = 60
ROLE_BONUS = 20
SCORE_CAP = 100
NO_BONUS_CAP = 50
NOTIFY_ROLES = ("lecturer", "tutor", "instructor")
SUBJECTS = [
    ("philosophy", "哲學", 65, ["philosophy", "philosophical", "哲學", "PPE"]),
    ("ethics", "倫理學", 65, ["ethics", "ethical decision making", "moral philosophy", "倫理", "道德哲學"]),
    ("critical-thinking", "批判思考", 65,
     ["critical thinking", "critical reasoning", "批判思考", "批判性思維"]),
    ("general-education", "通識", 60,
     ["general education", "liberal studies", "core curriculum", "common core", "通識"]),
    ("ai-literacy", "AI 素養", 70,
     ["AI literacy", "AI literacies", "AI applications and literacy",
      "artificial intelligence literacy", "人工智能素養", "人工智慧素養"]),
    ("ai-humanities", "AI 倫理／人文", 70,
     ["AI ethics", "ethics of AI", "ethical AI", "responsible AI", "AI and humanities",
      "AI in humanities", "AI literacies in humanities", "philosophy of AI",
      "artificial intelligence ethics", "人工智能倫理", "AI倫理"]),
]

# --- roles and employment --------------------------------------------------
ADJUNCT_FACULTY = r"\badjunct (?:teaching )?faculty\b"
ROLE_PATTERNS = [
    ("lecturer", r"\b(lecturers?|teachers?|teaching fellows?)\b|講師|教師"),
    ("tutor", r"\btutors?\b|導師"),
    ("instructor", r"\binstructors?\b|導師"),
]
TITLE_CUT = r"\bfor\b|\bto teach\b"
FULLTIME_STUDY = (r"fulltime (?:(?:day[- ]?)?(?:degree|subdegree|sub-degree|diploma) )?"
                  r"(?:programmes?|programs?|courses?|students?)")
PART_WORDS = r"parttime|兼職|兼任"
FULL_WORDS = r"fulltime|全職"
HOURLY_TITLE = r"hourly[ -]?(paid|rate)|時薪"
PART_BODY = (r"(recruiting|appoint(?:ment|ed)?|employ(?:ed|ment)?).{0,60}"
             r"(parttime (lecturer|instructor|tutor|teacher)|on a parttime basis)")
HOURLY_BODY = r"(salary|remuneration).{0,60}hourly rate"

# --- text cleaned before subject matching ----------------------------------
DEGREE_PHRASE = r"(?:doctor|master) of philosophy|teaching philosophy|personal philosophy"
APPLICANT_LINE = r"(applicants?|candidates?).{0,90}(?:possess|have|demonstrate)|具備.{0,30}能力"
TEACHING_LINE = r"teach|course|curriculum|授課|教授"
SKILL_PHRASE = r"critical thinking|批判思考|批判性思維"
# The lower-case wordings behind the three patterns, for plain substring tests.
FOOTER_WORDS = ["equal opportunit", "committed to equality", "code of conduct", "ethical conduct",
                "professional integrity"]
DEGREE_WORDS = ["doctor of philosophy", "master of philosophy", "teaching philosophy", "personal philosophy"]
SKILL_WORDS = ["critical thinking", "批判思考", "批判性思維"]
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"

# --- dates -----------------------------------------------------------------
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december"]
HYPHEN_DATE = r"(\d{1,2})-([A-Za-z]{3,9})-(20\d{2})"
YMD_DATE = r"(?<!\d)(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})(?:日)?(?!\d)"
DMY_DATE = r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s+(20\d{2})\b"
MDY_DATE = r"\b([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?[,]?\s+(20\d{2})\b"
CLOSING_LABEL = r"closing date|application deadline|截止日期|截止申請|截止報名"
EARLIER_WORDS = r"whichever is earlier"
ONGOING_NEAR_LABEL = r"until.{0,35}filled|on[ -]?going|長期|額滿即止"
REVIEW_LABEL = r"initial screening|review of applications|首輪|開始審閱"
ONGOING_LINE = r"until.{0,35}filled|on[ -]?going|額滿即止|長期招聘"
POSTED_LABEL = r"posted (on|date)|posting date|advertised|刊登日期|發布日期|發佈日期"
APPLY_BY = r"submit\s+(?:your|their|an?)\s+applications?\s+by\s+(\d{1,2}\s+[A-Za-z]+\s+20\d{2})"
APPLY_ON_OR_BEFORE = r"apply\s+on\s+or\s+before\s+(\d{1,2}\s+[A-Za-z]+\s+20\d\s?\d)"

# --- URLs ------------------------------------------------------------------
DROPPED_PARAMS = ("lang", "job-mail-subscribe-privacy")
DROPPED_PARAM_PREFIX = "utm_"

# --- page classification ---------------------------------------------------
CHALLENGE_MARKS = ["<title>just a moment", "<title>access denied", "cf-chl-",
                   "awswaf-captcha", "incapsula incident id"]
CHALLENGE_RESOURCE = "_incapsula_resource"
EMPTY_BODY = r"<body\b[^>]*>\s*</body>"

# --- transport error labels, first marker wins ------------------------------
ERROR_LABELS = [
    ("UNSAFE_LEGACY_RENEGOTIATION_DISABLED", "網站使用不相容的舊式 TLS 重新協商"),
    ("UNABLE TO GET LOCAL ISSUER CERTIFICATE",
     "憑證鏈未能連至本機信任的簽發者（需核對中繼憑證及信任庫）"),
    ("CERTIFICATE HAS EXPIRED", "網站憑證已過期"),
    ("HOSTNAME MISMATCH", "網站憑證的主機名稱不符"),
    ("SELF-SIGNED CERTIFICATE", "網站憑證鏈含未受信任的自簽憑證"),
    ("CERTIFICATE_VERIFY_FAILED", "網站憑證驗證失敗"),
    ("TLSV1_ALERT_PROTOCOL_VERSION", "網站 TLS 協議版本不相容"),
    ("SSLV3_ALERT_HANDSHAKE_FAILURE", "網站 TLS 握手失敗"),
    ("UNEXPECTED_EOF_WHILE_READING", "網站在 TLS 連線期間提早中斷"),
    ("WRONG_VERSION_NUMBER", "網站回應的 TLS 版本不符"),
]
ERROR_DEFAULT = "網站 TLS 連線未完成，原因待核對"

# --- publication -----------------------------------------------------------
PRIVATE_COLUMNS = ("content_hash", "match_text", "eligible_new_notification", "listing_fingerprint")
CSV_COLUMNS = ["institution", "title", "department", "employment_type", "posted_date", "deadline",
               "deadline_type", "deadline_raw", "url", "reference", "subjects", "score", "matches",
               "first_seen", "last_seen", "status", "description"]
FORMULA_START = r"\A\s*[=+\-@\t\r]"

# --- message texts ---------------------------------------------------------
DAILY_TITLE = "職位檢索每日摘要"
CHANGES_TITLE = "職位來源狀態更新"
DIGEST_COUNTS = "未完整來源 %d 個；恢復完整 %d 個。\n"
RECOVERED_MARK, ERROR_MARK, NOTICE_MARK = "✅ ", "⚠️ ", "ℹ️ "
RECOVERED_TEXT = "：已恢復完整檢索"
NO_REASON = "尚未取得完整資料"
CAPABILITY_LABELS = {"manual": "需手動查看", "pending": "尚未接入",
                     "list_only": "只有清單", "partial": "部分內容未接入"}
DIGEST_MORE = "另有 %d 個來源，請查看網站「來源狀態」。\n"
DIGEST_FOOTER = "已保留歷史資料；未完成檢索不代表沒有新職位。"
NEW_JOB_TITLE = "新發現相關職位｜"
NEW_JOB_POSTED, NEW_JOB_NO_POSTED, NEW_JOB_SEEN = "刊登：", "網站未提供", "｜首見："
NEW_JOB_SUBJECTS, NEW_JOB_DEADLINE = "科目：", "截止："
NEW_JOB_SEE_PAGE, NEW_JOB_ONGOING = "請查看原文", "請查看原文／持續招聘"
NEW_JOB_FOOTER = "相關度只反映科目及聘用類型，請自行核對學歷和經驗要求。"
