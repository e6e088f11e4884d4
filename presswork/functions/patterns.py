"""What lines and texts are recognised by: the vocabulary that the rules are defined with. Alternatives are listed one by one, in
alphabetical order; ``java`` and ``re2`` give the pattern for Spark and for the oracles. Letters match in either case.

A text is first searched for the literals of which every match holds one, which is cheap; only where one occurs is the pattern tried."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import JAVA_SPACES, SPACES, WORD

try:
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_parse as parser

S, S0 = f"[{SPACES}]+", f"[{SPACES}]*"


def _literals(tree: parser.SubPattern) -> set[str] | None:
    """The best of the lists of literals that the parts of a sequence give: the one whose shortest is longest."""
    best: set[str] | None = None
    run = ""

    def offer(new: set[str] | None) -> None:
        nonlocal best
        if new and (best is None or min(map(len, new)) > min(map(len, best))):
            best = new

    for op, arg in [*tree, (None, None)]:
        if op is parser.LITERAL:
            run += chr(arg).lower()
            continue
        offer({run} if run else None)
        run = ""
        if op is parser.SUBPATTERN:
            offer(_literals(arg[-1]))
        elif op is parser.BRANCH:
            each = [_literals(b) for b in arg[1]]
            offer(set().union(*each) if all(each) else None)
        elif op is parser.MAX_REPEAT and arg[0] > 0:
            offer(_literals(arg[2]))
    return best


class Pattern:
    def __init__(self, alternatives: Iterable[str], prefix: str = "", suffix: str = ""):
        body = "|".join(a.replace("~+", S).replace("~*", S0).replace("~", f"[{SPACES}]").replace("¤", WORD) for a in alternatives)
        self.body = f"{prefix}(?:{body}){suffix}".replace("¤", WORD)

    @property
    def java(self) -> str:
        return "(?iu)" + self.body.replace(SPACES, JAVA_SPACES)

    @property
    def re2(self) -> str:
        return "(?i)" + self.body

    @functools.cached_property
    def needs(self) -> list[str] | None:
        """Literals of which a match holds at least one; none if the pattern has no such list."""
        plain = self.body.replace(f"[{SPACES}]", r"\s").replace(SPACES, r"\s").replace(WORD, r"\w").replace(r"\p{L}\p{N}", r"\w").replace(r"\p{Nd}", r"\d")
        found = _literals(parser.parse(plain))
        return sorted(found) if found and min(len(x.encode()) for x in found) > 1 else None

    def may(self, c: Column) -> Column:
        """Whether the pattern may occur: false only where it doesn't."""
        if self.needs is None:
            return F.lit(True)
        words = F.array(*[F.lit(x) for x in self.needs])
        # exists over an array of one names the lower-cased text, so that it is made once; the odd letters match s and i in any case
        return F.exists(F.array(F.lower(c)), lambda low: F.exists(words, lambda w: F.contains(low, w))) | F.contains(c, F.lit("ſ")) | F.contains(c, F.lit("ı")) | F.contains(c, F.lit("İ"))

    def __call__(self, c: Column) -> Column:
        return self.may(c) & c.rlike(self.java) if self.needs else c.rlike(self.java)

    def sql(self, x: str) -> str:
        return f"regexp_matches({x}, '" + self.re2.replace("'", "''") + "')"


SIGNAL = Pattern("assert denied econn enoent error exception failed failure fatal invalid mismatch".split() + ["not found"] + "panic timeout traceback warning".split())
ERROR_DENSE = Pattern(
    [r"\.py:[0-9]+", r"^~*(?:ERROR|FAIL:|FAILED)", "assertionerror", r"\berror\b", r"\bexception\b", r"\bfailed\b", r"raise~+¤*error", r"traceback \(most recent call last\)"]
)
TOOL_ERROR = Pattern(
    [r"\b" + w + r"\b" for w in ("abort(?:ed|ing)?", "denied", "error", "exception", "failed", "timeout", "e[0-9]{3,5}")]
    + ["command not found", "exit (?:code|status) [1-9]", "fatal:", "no such file", r"traceback \(most recent call last\)"]
)

# fetched pages
BOILERPLATE = Pattern(
    [
        "©", "accept~+(?:all~+)?cookies", "advertisement", "all~+rights~+reserved", "back~+to~+top", "breadcrumb", "click~+here~+to", "cookie~+(?:banner|consent|policy)",
        "copyright~+©?", r"create~+an?~+account\b", "follow~+us~+on", "home~*>~*", r"log~*in\b", "privacy~+policy", r"register\b", "related~+(?:articles|posts)", "share~+(?:on|this)~",
        "sign~*up~+for~+(?:our~+)?newsletter", "skip~+to~+(?:content|main)", "sponsored~+content", "subscribe~+(?:for|now|to)", "table~+of~+contents", "terms~+of~+(?:service|use)", "you~+may~+also~+like",
    ]
)
ERROR_PAGE = Pattern(
    [r"^~*(?:40[134]|50[023])\b", "access~+denied", "captcha", "content~+unavailable", "forbidden", "page~+not~+found", "please~+verify~+you~+are~+human", "rate~+limit~+exceeded"]
)
NOISE = Pattern(
    [r"\+1", "bump", "following(?:~+this)?", "haha", "lol", "me~*too", "nice", "thanks(?:~+for~+sharing)?", "this(?:~+is~+great)?", "unsubscribed"],
    "^", r"[^\p{L}\p{N}_]?.{0,40}$",
)
REPLY = Pattern(["reply~*[0-9]+~*:~*"], "^")
QUOTED = Pattern(['["“”].{10,}["“”]'])
LINK = Pattern(["https?://"])

# support threads
PLEASANTRY = Pattern(
    [
        "(?:please )?hold (?:on |)for a (?:minute|moment)", "good (?:afternoon|evening|morning)", "have a (?:great|nice|wonderful) (?:day|evening)", "hello", "hey", "hi", "how can i help (?:you)?",
        "is there anything else(?: i can (?:do for|help))? (?:you (?:with )?)?(?:for you|today)?", "let me know if(?: there is| there's) anything else", "one moment (?:please )?while i",
        "thank you for (?:holding|waiting|your patience)", "thanks?(?: you)?(?: for (?:choosing|contacting|reaching out|your patience))?", "welcome", "what can i (?:do|help).{0,20}for you",
    ],
    "^", r"[^\p{L}\p{N}_]?.{0,60}$",
)
APOLOGY = Pattern(
    [
        "(?:apologies|i apologize|i(?:'m| am) (?:really |so |very )?sorry) for (?:any inconvenience|the delay|the inconvenience|the trouble|the wait|this experience|your experience)",
        "i (?:completely |fully |totally )?understand (?:how|that).{0,40}(?:difficult|frustrating|inconvenient|upsetting)",
        "i(?:'m| am) sorry to hear (?:about|that)", "thank you for your understanding.{0,40}$",
    ]
)
FACT = Pattern(
    [
        r"(?:account|case|confirmation|invoice|order|reference|ticket)~*(?:#|no\.?|number)?~*[:#]?~*[\p{L}\p{N}_\-]{4,}",
        r"(?:balance|charged?|credit|refund|total)~+of?~*\$?[0-9,]+(?:\.[0-9]{2})?", r"\b(?:date of birth|dob|last four|ssn)\b.{0,20}[0-9]",
        "cancelled", "escalated", "fixed", "processed", "refund issued", "resolution", "resolved", "scheduled", "shipped",
    ]
)
REVERIFY = Pattern(
    [r"\b(?:again|confirm|once more|provide|re-?enter|share|verify)\b.{0,40}(?:account|address|case number|date of birth|dob|email|last four|order number|phone|ssn)"]
)

# pipeline logs
PROGRESS = Pattern(
    [
        r"\.\.\.~*done~*$", r"^~*(?:[0-9]+%|[0-9]+~*/~*[0-9]+)~*[\[|#=-]*~*$", "checkpoint~+saved", r"heartbeat\b", "poll~+#[0-9]+~*:~*no new (?:data|records)", "progress~*:~*[0-9]+~*%",
        "rows~+processed~*:~*[0-9]+$", "still (?:loading|processing|running)", "waiting for (?:data|executor|upstream)",
    ]
)
BANNER = Pattern(
    ["authenticated as", "connected to", "connecting to", "established connection", "session started", "spark session", "using profile", r"version~+[0-9]+(?:\.[0-9]+)+", "warehouse~*:~*¤+"]
)
STEP_ERROR = Pattern(
    ["assert", "column .* not found", "constraint (?:failed|violation)", "deadlock", "error", "exception", "failed", "fatal", "oom", "out of memory", "permission denied", "raise ", "timeout", "traceback"]
)
SCHEMA = Pattern(
    [
        '"type"~*:~*"(?:boolean|integer|number|string)"', r"\bbigint\b", r"\bnot~+null\b", r"\btimestamp\b", r"\bvarchar\b", r"^~*¤+~+(?:bool(?:ean)?|date|double|float|int(?:eger)?|string)\b",
        "alter~+table", "create~+table", "dtype~*:", "foreign~+key", "primary~+key", "schema~*:",
    ]
)
METRIC = Pattern(
    [
        "(?:checksum|md5|sha[0-9]*)~*[:=]?~*[0-9a-f]{6,}", r"(?:duration|elapsed)~*[:=]?~*[0-9]+(?:\.[0-9]+)?~*(?:min|ms|s|sec)", r"(?:pipeline|step)~+(?:completed|failed|succeeded)\b",
        "rows?~*(?:deleted|inserted|loaded|processed|read|rejected|scanned|skipped|updated|written)~*[:=]?~*[0-9,]+", "total~+rows~*[:=]~*[0-9,]+",
    ]
)

# spoken dialogue
CONFIRM = Pattern(
    [
        r"\b(?:can you (?:please )?repeat|come again|did you say|just to confirm|let me (?:just )?confirm|say that again|so (?:that'?s|you'?re)|sorry,? (?:how|what|who))\b.{0,60}"
        "(?:account|address|amount|date|email|name|number|order|phone|time)"
    ]
)
COMMIT = Pattern(
    [
        "alarm set", "appointment (?:confirmed|set)", "booked", "booking (?:confirmed|reference)", r"charged \$?[0-9,]+(?:\.[0-9]{2})?", "confirmation (?:#|code|number)", "confirmed for", "delivery (?:scheduled|set)",
        "order (?:confirmed|number|placed)", "reference (?:#|number)", "reminder set", "reservation (?:#|confirmed)", "scheduled for", "timer set", r"total (?:came to|is|of) \$?[0-9,]+(?:\.[0-9]{2})?", "tracking (?:#|number)",
    ]
)
VOICE_FACT = Pattern(
    [
        r"\$[0-9][0-9,]*(?:\.[0-9]{2})?", r"[0-9]{3}[-.~]?[0-9]{3}[-.~]?[0-9]{4}".replace("~", SPACES), r"\b(?:friday|monday|saturday|sunday|thursday|tuesday|wednesday)\b", r"\b[0-9]{1,2}:[0-9]{2}~*(?:am|pm)\b",
        r"\b[0-9]{1,5}~+¤+(?:~+¤+){0,3}~+(?:ave|blvd|court|ct|dr|ln|rd|st|way)\b",
    ]
)
BACKCHANNEL_WORDS = sorted(
    {"exactly", "absolutely", "alright", "got", "okay", "ok", "yep", "yup", "yeah", "sure", "right", "great", "cool", "nice", "of", "course", "thanks", "thank", "you", "listening",
     "go", "on", "see", "i", "it", "huh", "uhuh", "uh", "mm", "mhm", "mmhmm", "hmm"}
)
BACKCHANNEL_SKIPPED = ["am", "i", "it", "m"]
FILLER_WORDS = sorted({"hang", "second", "sec", "on", "me", "let", "see", "well", "so", "mean", "know", "you", "like", "ah", "erm", "uhh", "uh", "umm", "um"})
CONTENTLESS = sorted(
    {"how", "where", "when", "what", "no", "yes", "not", "but", "so", "or", "and", "it", "that", "this", "should", "could", "can", "would", "will", "had", "has", "have", "did", "does", "do",
     "be", "was", "were", "are", "is", "in", "on", "for", "of", "to", "an", "a", "the", "we", "your", "you", "my", "me", "i"}
)

# chunk policies
HEARTBEAT = Pattern(["^~*200 OK", "cpu usage", "directory listing", "drwx", "health ?check", "heartbeat", "no changes", "nothing to commit", "ok$", "total [0-9]+", "uptime"])
QUICK_NOISE = Pattern([r"^# query_time: 0\.00", "^drwx", r"^total [0-9]+", "added package-", "heartbeat ok", "npm notice"])
