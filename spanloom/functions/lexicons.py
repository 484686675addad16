"""Word lists, label tables and patterns.

Fixed values: they have to equal those of the annotation scheme that results are compared with.
"""

LABELS = ("Actor", "Action", "Effect", "Victim", "Evidence")

# Document labels as annotators write them, and what they mean.
DOC_LABELS = {
    "yes": "conspiracy", "y": "conspiracy", "consp": "conspiracy", "conspiracy": "conspiracy",
    "no": "non", "n": "non", "non": "non", "not conspiracy": "non",
    "can't tell": "cant_tell", "cant tell": "cant_tell", "cant_tell": "cant_tell", "uncertain": "cant_tell", "unknown": "cant_tell",
}
STRICT_LABELS = {"Yes": "conspiracy", "No": "non", "Can't tell": "cant_tell"}
VERDICT_YES = ("yes", "true", "conspiracy", "conspiracy theory", "1")
VERDICT_NO = ("no", "false", "non", "not conspiracy", "0")
MARKER_ALIASES = {"actors": "Actor", "actions": "Action", "effects": "Effect", "victims": "Victim", "evidences": "Evidence", "actor": "Actor", "action": "Action", "effect": "Effect", "victim": "Victim", "evidence": "Evidence"}

# Keys under which records keep the same thing, in order of precedence.
ID_KEYS = ("_id", "id", "doc_id", "reddit_id", "submission_id", "source_id")
SOURCE_KEYS = ("subreddit", "community", "source_subreddit")
TEXT_KEYS = ("text", "plain_text", "content", "submission_statement", "ss_text", "body")
LABEL_KEYS = ("conspiracy", "conspiracy_label", "binary_label", "doc_label", "label", "is_conspiracy")

ABSOLUTIST = ("always", "never", "everyone", "no one", "impossible", "undeniable", "without a doubt", "completely", "totally", "entirely", "absolutely", "certainly", "no doubt", "truth", "fact", "proven")
HEDGES = ("maybe", "perhaps", "possibly", "likely", "unlikely", "appears", "seems", "suggests", "might", "could", "may", "arguably", "allegedly", "reportedly", "claimed")

# Cues of the subtypes of a document.
CUES_MUNDANE = ("office", "wages", "manager", "boss", "weather", "traffic", "customer service", "refund", "price", "scam", "bs", "myth", "work from home", "policy", "HR", "commission", "fee")
CUES_DEBUNK = ("debunk", "no evidence", "false claim", "conspiracy theory", "not true", "lies", "fact check", "hoax", "bullshit", "ridiculous")
CUES_EVANGELIST = ("wake up", "the truth", "universal truth", "mission", "listen to", "watch this", "series", "documentary", "red pill", "must watch", "share this")
CUES_INSIDER = ("deep state", "cabal", "regime", "globalist", "agenda", "controlled by", "owned by", "false flag", "psyop", "elites", "intelligence", "shadow", "new world order")

# Words that the document profile counts.
ATTRIBUTION = ("said", "says", "stated", "claimed", "claims", "reported", "reporting", "according", "cited", "quoted", "tweeted", "announced", "sources")
UNCERTAINTY = ("maybe", "perhaps", "possibly", "could", "might", "wonder", "unsure", "question", "curious", "seem", "appears", "allegedly", "unknown")
INTENSITY = ("proof", "proven", "truth", "fact", "undeniable", "obvious", "clear", "expose", "revealed", "woke", "awakened", "reality", "lying")
PASSIVE = ("been", "being", "was", "were", "by")

# Reasons why a fetched text is missing.
MISSING = ("deleted", "removed", "empty_body", "invalid_body", "not_found")
