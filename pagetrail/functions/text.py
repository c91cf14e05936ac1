"""Text functions: normalising, tokenising, n-grams, classes of words and lines, redaction, links, chunks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters folded by the n-gram matcher, ligatures and their parts, speaker tags, function words.
LONG_U = "ûùüú"
LIGATURES = {"ﬓ": "մն", "ﬔ": "մե", "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ", "և": "եւ"}
SPEAKERS = {"CHR": "choir", "CLB": "celebrant", "DCN": "deacon", "SRK": "deacon"}
SPEAKER_TAGS = SPEAKERS | {"ՔՀՆ": "celebrant", "ԴՊՐ": "celebrant", "ՍՐԿ": "deacon"}
CUES = ("the", "and", "of", "lord", "with", "for")
SCRIPT = r"[\x{0530}-\x{058F}\x{FB00}-\x{FB17}]"
LATIN = r"[\x{0041}-\x{007A}\x{00C0}-\x{024F}]"


def _folded() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without them."""
    marked = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower()}
    marked = {c: base for c, base in marked.items() if base != c and base.isascii()}
    return "".join(marked), "".join(marked.values())


FOLD_FROM, FOLD_TO = _folded()


def normalize_text(col: Column, *, profile: str = "ngram") -> Column:
    """``ngram`` takes ligatures apart, folds accents (û, ù, ü and ú to oo) and keeps letters a-z, digits and Armenian script; ``page_id``
    keeps letters and digits; ``live`` keeps letters. The rest becomes single spaces. Null stays null."""
    low = F.lower(col)
    if profile == "ngram":
        for ligature, parts in LIGATURES.items():
            if ligature >= "ﬓ":  # not the letter ew
                low = F.replace(low, F.lit(ligature), F.lit(parts))
        low = F.translate(F.regexp_replace(low, f"[{LONG_U}]", "oo"), FOLD_FROM, FOLD_TO)
        low = F.regexp_replace(low, r"[\x{0300}-\x{036F}]", "")
        kept = r"[^a-z0-9\x{0530}-\x{058F}]+"
    elif profile == "page_id":
        kept = r"[^\p{L}\p{N}]+"
    elif profile == "live":
        kept = r"[^\p{L}]+"
    else:
        raise ValueError(profile)
    return F.trim(F.regexp_replace(low, kept, " "))


def page_id(col: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalize_text(col, profile="page_id"), 256), 1, 16)


def tokenize(df: DataFrame, text_col: str, *, pattern: str = r"\p{L}+", min_len: int = 2) -> DataFrame:
    """A row for each match of ``pattern`` of ``min_len`` characters or more: the other columns, ``pos`` from 1, ``word``."""
    found = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= min_len)
    keys = [c for c in df.columns if c != text_col]
    return df.select(*keys, F.posexplode(found).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


def ngrams(words: Column, n: int = 2) -> Column:
    """All runs of n words joined by spaces; fewer than n words make one; none make none."""
    size = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(F.array_join(words, " "))).otherwise(runs)


def decompose_ligatures(col: Column) -> Column:
    for ligature, parts in LIGATURES.items():
        col = F.replace(col, F.lit(ligature), F.lit(parts))
    return col


def split_syllables(col: Column, *, vowels: str = "aeiouy") -> Column:
    """A syllable closes after each vowel; consonants that remain join the last one."""
    closed = F.regexp_extract_all(col, F.lit(f"[^{vowels}]*[{vowels}]"), F.lit(0))
    rest = F.regexp_extract(col, f"([^{vowels}]*)$", 1)
    n = F.size(closed)
    return F.when(n == 0, F.array(col)).otherwise(F.concat(F.slice(closed, F.lit(1), n - 1), F.array(F.concat(F.element_at(closed, -1), rest))))


def script_of(word: Column) -> Column:
    """``armenian`` if more than half the characters are of that script; else, if more than half are Latin, ``phonetic`` where the word
    has û, é, ô, oo, ts, dz or two consonants in a row, ``english`` otherwise; else null."""
    share = lambda p: F.length(F.regexp_replace(word, f"[^{p[1:]}", "")) / F.length(word)
    sounds = word.rlike("û|é|ô|oo|ts|dz|[bcdfghjklmnpqrstvwxz]{2}")
    return F.when(share(SCRIPT) > 0.5, "armenian").when(share(LATIN) > 0.5, F.when(sounds, "phonetic").otherwise("english"))


def section_of(line: Column) -> Column:
    """A line's section: skipped (null) if short or a stage direction, ``grapar`` with three script letters, ``phonetic`` with a speaker
    tag and two vowels in a row but no English function word, ``english`` with a function word or tag, else null."""
    cue = line.rlike(r"(?i)\b(" + "|".join(CUES) + r")\b")
    tag = line.rlike("^(" + "|".join(SPEAKERS) + r")\.")
    return F.when((F.length(F.trim(line)) < 3) | line.rlike(r"^\s*[\(\[]"), F.lit(None)).when(line.rlike(f"({SCRIPT}.*){{3}}"), "grapar").when(tag & line.rlike("[aeiou]{2}") & ~cue, "phonetic").when(cue | tag, "english")


def detect_language(col: Column) -> Column:
    """``grapar`` with three script letters, ``english`` with a cue word, else ``phonetic``."""
    return F.when(col.rlike(f"({SCRIPT}.*){{3}}"), "grapar").when(col.rlike(r"(?i)\b(" + "|".join(CUES) + r")\b"), "english").otherwise("phonetic")


def clamp(col: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def explain_advance(score: Column, speaker_changed: Column) -> Column:
    """Why a page turn was taken, by score tier."""
    return F.when(speaker_changed & (score > 0.9), "speaker change, strong match").when(speaker_changed, "speaker change").when(score > 0.9, "strong match").when(score > 0.75, "match").otherwise("weak match")


# Sounds of letters, of letters in place (rules in order, ^ is the start of a word), and abbreviations.
LETTERS = dict(zip("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "a p k t e z e u t zh i l kh dz g h ts gh ch m y n sh o ch b j r s v d r ts v p k o f".split(), strict=True))
IN_PLACE = (("^ու(?=[աեիոօէը])", "vo"), ("ու(?=[աեիոօէը])", "v"), ("ու", "oo"), ("իւ", "yoo"), ("^եւ", "yev"), ("եւ", "ev"), ("^ե", "ye"), ("^ո", "vo"), ("^Ե", "Ye"), ("^Ո", "Vo"))
ABBREVIATIONS = {"ԴՊՐ": "Tpir", "ՍՐԿ": "Srk", "ՔՀՆ": "Khn", "ԿԱՆԳՆԻԼ": "Gankneel", "ՆՍՏԻԼ": "Nsdeel", "ՈՏՔԻ": "Vodki"}
_SOUNDS = str.maketrans(LETTERS | {k.upper(): v.capitalize() for k, v in LETTERS.items()})
_TRAIL = re.compile(r"[\s.,:;՛՜՝՞։֊]+$")


def _romanise(word: str, double_r: bool = False) -> str:
    for ligature, parts in LIGATURES.items():
        word = word.replace(ligature, parts)
    word = _TRAIL.sub("", word)
    if word in ABBREVIATIONS:
        return ABBREVIATIONS[word]
    word = re.sub("[^\u0531-\u0556\u0561-\u0587]", "\0", word)  # characters of other scripts have no sound, but keep their place
    for rule, sound in IN_PLACE:
        word = re.sub(rule, sound, word)
    word = word.replace("Ռ", "Rr") if double_r else word
    return re.sub(r"[^A-Za-z]", "", word.translate(_SOUNDS))


def transliterate(word: Column, *, profile: str = "matcher") -> Column:
    """Script words as Latin sounds: ligatures apart, trailing marks gone, digraphs and first letters by rule, other letters one by one,
    unknown characters skipped; a capital gives a capital. Profile ``dictionary`` writes a capital Ռ as Rr. Apply it to distinct words and join back."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else _romanise(w, profile == "dictionary"))

    return run(word)


# Shapes of secrets (matched in any case), and how much of a long one stays.
SECRETS = (
    r"""\b[A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)\b\s*[=:]\s*(["']?)([^\s"'\\]+)\1""",
    r"""\"(?:apiKey|token|secret|password|passwd|accessToken|refreshToken)\"\s*:\s*\"([^\"]+)\"""",
    r"""--(?:api[-_]?key|token|secret|password|passwd)\s+(["']?)([^\s"']+)\1""",
    r"Authorization\s*[:=]\s*Bearer\s+([A-Za-z0-9._\-+=]+)",
    r"\bBearer\s+([A-Za-z0-9._\-+=]{18,})\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----",
    r"\b(sk-[A-Za-z0-9_-]{8,})\b",
    r"\b(ghp_[A-Za-z0-9]{20,})\b",
    r"\b(github_pat_[A-Za-z0-9_]{20,})\b",
    r"\b(xox[baprs]-[A-Za-z0-9-]{10,})\b",
    r"\b(xapp-[A-Za-z0-9-]{10,})\b",
    r"\b(gsk_[A-Za-z0-9_-]{10,})\b",
    r"\b(AIza[0-9A-Za-z\-_]{20,})\b",
    r"\b(pplx-[A-Za-z0-9_-]{10,})\b",
    r"\b(npm_[A-Za-z0-9]{10,})\b",
    r"\b(\d{6,}:[A-Za-z0-9_-]{20,})\b",
)
WHOLE, FIRST, LAST = 18, 6, 4


def mask(secret: str) -> str:
    return "***" if len(secret) < WHOLE else f"{secret[:FIRST]}…{secret[-LAST:]}"


def _masked(m: re.Match) -> str:
    if "PRIVATE KEY-----" in m[0]:
        lines = [x for x in re.split(r"\r?\n", m[0]) if x]
        return "***" if len(lines) < 2 else f"{lines[0]}\n…redacted…\n{lines[-1]}"
    secret = next((g for g in reversed(m.groups()) if g), m[0])
    return m[0].replace(secret, mask(secret), 1)


def redact(col: Column, *, patterns: tuple[str, ...] = SECRETS) -> Column:
    """Secrets masked: fewer than 18 characters to ``***``, longer ones to first six and last four; keys in PEM keep their first and last
    line. Only texts in which a pattern is found go to Python, where the mask is made of what was found. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p, re.I | re.A) for p in patterns]

        def clean(text: str | None) -> str | None:
            for p in compiled if text is not None else ():
                text = p.sub(_masked, text)
            return text

        return texts.map(clean)

    met = F.lit(False)
    for p in patterns:
        met = met | col.rlike(f"(?i){p}")
    return F.coalesce(run(F.when(met, col)), col)


def redact_fixed(col: Column, *, pattern: str = r"(password=)[^\s]+") -> Column:
    return F.regexp_replace(col, pattern, "$1***")


def extract_links(col: Column, *, max_links: int = 3) -> Column:
    """Distinct bare http links outside markdown links, none to the own machine, the first ``max_links``."""
    bare = F.regexp_replace(col, r"\[[^\]]*\]\([^)]*\)", " ")
    found = F.regexp_extract_all(bare, F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda u: ~u.contains("://127.0.0.1"))), 1, max_links)


def _cut(text: str, limit: int, mode: str) -> list[str]:
    if mode == "newline":
        return [p for line in text.split("\n") if line for p in _cut(line, limit, "length")]
    if mode == "paragraph":
        out: list[str] = []
        fence = False
        for block in re.split(r"\n\s*\n", text):
            if out and (fence or len(out[-1]) + 2 + len(block) <= limit):
                out[-1] += "\n\n" + block
            else:
                out.append(block)
            fence ^= block.count("```") % 2 == 1
        return [p for block in out if block.strip() for p in ([block] if "```" in block else _cut(block, limit, "length"))]
    out = []
    while len(text) > limit:
        window, depth, space, line = text[: limit + 1], 0, -1, -1
        for i, c in enumerate(window):
            depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
            if c == "\n":
                line = i
            elif c.isspace() and depth == 0:
                space = i
        at = line if line > 0 else space if space > 0 else limit
        out.append(text[:at].rstrip())
        text = text[at:].lstrip() if at < limit or text[at : at + 1].isspace() else text[at:]
    return [p for p in [*out, text] if p]


def chunk_text(col: Column, *, limit: int = 4000, mode: str = "length") -> Column:
    """Pieces of at most ``limit`` characters, cut at the last newline, else at the last space outside parentheses, else hard; modes
    ``newline`` and ``paragraph`` cut there first, the latter never inside a code fence. Null gives null, blank gives none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _cut(t, limit, mode))

    return run(col)
