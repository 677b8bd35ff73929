"""Term lists and scores that results depend on.  Fixed values."""

COMPLAINT = ("can't", "cannot", "broken", "frustrated", "frustrating", "annoying", "hate", "terrible", "awful", "useless", "fail", "failing", "doesn't work", "won't work", "keeps crashing", "impossible", "so bad", "worst")
UNSOLVED = ("how do i", "how can i", "help me", "stuck on", "can't figure", "anyone know", "is there a way", "not sure how", "struggling with")
WISH = ("wish", "would be nice", "feature request", "please add", "why doesn't", "why can't", "should have", "needs to have", "lacks", "missing")
CONSUMER = ("game", "gaming", "xbox", "playstation", "steam", "fortnite", "netflix", "movie", "tv show", "boyfriend", "girlfriend", "roommate")
BUSINESS = ("shopify", "agency", "client", "saas", "invoice", "crm", "workflow", "automation", "support team", "ecommerce", "b2b", "operations", "vendor", "customer", "subscription", "marketing")
COMPETITORS = ("jira", "shopify", "salesforce", "quickbooks", "hubspot", "zendesk", "notion", "airtable", "slack", "asana", "monday")
PROCESS = ("manual", "process", "workflow", "spreadsheet", "csv", "approval", "handoff", "sync", "pain")
SAME_HERE = ("same here", "same issue", "same problem", "me too", "we have this too", "we hit this too")
CONSENSUS = ("we hit this", "also", "us too", "same pain", "here too")
WORKAROUND = ("manual workaround", "workaround", "export csv", "export to csv", "spreadsheet", "sheets", "copy paste", "copy/paste", "re-upload", "reupload", "script around", "zapier", "glue code")
SHILL = ("try our tool", "book a demo", "sign up", "dm me", "reach out", "check out my", "we can help", "our product")
LINKS = ("http://", "https://")
HIGH_IMPACT = ("lose sales", "lost sales", "lost revenue", "revenue", "churn", "customers complain", "customer escalations", "compliance", "security risk", "refund")
MEDIUM_IMPACT = ("hours", "days", "manual", "spreadsheet", "reconcile", "delay", "backlog", "broken", "failing", "crash", "error")
SOLVED = ("fixed it", "solved", "resolved", "works now", "ended up using", "switched to", "temporary workaround")
HIGH_FREQUENCY = ("every day", "daily", "every week", "weekly", "all the time", "each time", "every time", "constantly")
FREQUENCY_CONTEXT = ("manual", "spreadsheet", "export", "reconcile")
EVIDENCE = ("manual", "hours", "days", "$", "spreadsheet", "workaround", "broken")

COMPARISON = (" vs ", "versus", "alternative to", "compare", "comparison")
PITCH = ("launching", "i built", "we built", "looking for cofounder", "serious only", "my saas")
NEWS = ("news recap", "industry news", "weekly recap", "analysis", "lawsuit")
AGGREGATED = ("my clients", "our clients", "customer interviews", "i interviewed", "we interviewed")
SECOND_HAND = ("my customer", "our customer", "my team", "our team")
FIRST_HAND = (" i ", " i'm ", " i’ve ", " i've ", " my ", " we ", " we're ", " our ")
HEARSAY = ("people say", "founders say", "users say", "everyone says")
#: In order: the first set with a hit decides.
AUTHORITY = (
    ("founder_owner", ("founder", "cofounder", "business owner", "owner", "ceo")),
    ("head_of_ops", ("head of ops", "head of operations", "director of ops", "vp operations", "ops lead")),
    ("agency_operator", ("agency", "client work", "client projects", "freelance agency")),
    ("intern", ("intern", "student", "graduate")),
    ("manager", ("manager", "team lead", "lead ")),
    ("engineer", ("engineer", "developer", "devops", "sysadmin", "sre")),
    ("ic", ("analyst", "specialist", "coordinator", "individual contributor")),
)
AUTHORITY_SCORES = {"intern": 0.35, "ic": 0.6, "engineer": 0.72, "manager": 0.82, "head_of_ops": 0.94, "founder_owner": 1.0, "agency_operator": 0.88, "unknown": 0.55}
HANDNESS_SCORES = {"first_hand": 1.0, "second_hand": 0.78, "aggregated": 0.7, "speculative": 0.45, "unknown": 0.58}

#: In the order in which failure signals are listed.
FAILURES = (
    ("pricing_pain", ("price", "pricing", "cost", "expensive", "renewal", "billing", "license")),
    ("missing_feature", ("missing", "lacks", "feature", "does not support", "approval routing")),
    ("lock_in_switching_churn", ("lock-in", "lock in", "switch", "churn", "migrate", "can't export", "cannot export", "contract")),
    ("reliability_support_failure", ("support", "reliability", "failure", "fails", "failing", "broken", "bug", "outage")),
    ("workaround", ("workaround", "manual", "spreadsheet", "csv", "zapier")),
)
WTP_PATTERN = r"\bwould\s+pay\b|\bpay(?:ing)?\b|\bpaid\b|\bbudget\b|\bspend(?:ing)?\b|\bpricing\b|\brenewal\b|\bsubscription\b|\blicen[cs]e\b|[$€£]"
STOPWORDS = ("about", "after", "again", "because", "before", "between", "breaks", "daily", "every", "from", "have", "keeps", "manual", "need", "still", "team", "teams", "their", "this", "with", "your")
FEEDBACK = ("useful", "not_a_pain", "duplicate", "too_generic", "wrong_segment", "bad_evidence")
