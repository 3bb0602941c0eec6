"""Keyword-stuffed, link-list and product-tag pages among commit histories.

A document's message and its added lines are judged apart, after undoing the usual disguises. Two passes over the texts' words:

1. One map makes the figures of every part (top-word and n-gram share, duplicate-line share, link-text ratio, separator density) and counts in how many
   messages of its language each word stands. What is frequent there are the language's function words and common words: they are
   learned from the corpus, with a short list of closed-class words as a start for small ones. No list of advertising words takes part.
2. Lines are marked where such a figure is far beyond the usual *and* function words are missing, with bounds from the language's own share of
   function words and its usual figures. A part is promotional if most of its characters stand in marked lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import folded
from ..session import settle, spread

#: Closed-class words that a small corpus starts from; the rest is learned.
FUNCTION_WORDS = frozenset(
    (
        "the a an of to in on for and or is are was were be been that this it its which with without by from as at not no so when than then has had have we may can could should now after before until only "
        "der die das den dem des ein eine einer und oder ist sind war wird nicht mit ohne von zu im am für auf bei nach auch wie nun jetzt "
        "le la les un une des du de et ou est sont était ne pas plus avec sans par pour sur dans que qui ce cette on "
        "el los las una y o es son era no con sin por para en que se lo al del su "
        "os as um uma e ou é são era não com sem por para em no na do da que se"
    ).split()
)

_ZERO_WIDTH = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_DOTTED = re.compile(r"(?<!\w)\w(?:\.(?: \.|\.)?\w){2,}(?!\w)")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "+": "t", "@": "a", "$": "s"})
_LEET_WORD = re.compile(r"(?<![^\s\"'(,])(?=[\w+@$]{0,40}[013457+@$])(?=[\w+@$]{0,40}[^\W\d_])(?!\d{1,9}\w{0,2}(?:\s|$))[\w+@$]{2,40}(?![^\s\"'),.:;!?])")
_DISGUISE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]" + r"|\[\.\]|hxxp|(?<!\w)\w\.\w\.(?:\.| \.)?\w(?!\w)|(?<!\w)\w\.\w\.\w\.\w", re.I)

_URL_RE = re.compile(r"(?:(?:https?|ftp)://[^\s<>\"')\]]+|(?<![\w@/.-])(?:[\w-]{1,63}\.){1,8}[a-z]{2,8}/[^\s<>\"')\]]*)", re.I)
_HOST = re.compile(r"^(?:\w+://)?([^/?#:]+)")
# possessive, so that no start is tried twice and an anchor may be of any length
_HTML_LINK = re.compile(r"<a\b(?>[^<>]*?\bhref=)[\"']?([^\"'<>\s]++)[^<>]*+>([^<]*+)</a>", re.I)
_MD_LINK = re.compile(r"\[([^\[\]]*+)\]\(([^)\s\[]*+)\)")
_BB_LINK = re.compile(r"\[url=([^\]\[]*+)\]([^\[]*+)\[/url\]", re.I)
_TAGS = re.compile(r"</?\w++[^<>]*+>|\[/?\w++\]")
_CONTENT = re.compile(r"content=[\"']([^\"']*+)[\"']", re.I)
_MARKS = re.compile(r"^(?:/\*+|\*/|\*|//|--|#(?!\w)|<!--|;|[-+•·])|(?:\s?(?:\*/|-->|<br ?/?>|\|)){1,8}$")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_HASHTAG = re.compile(r"(?<!\S)#(?=\w*[^\W\d_])\w{5,}")
_SEPARATOR = re.compile(r"[•·|;,/\t–—]|\s-\s|\s{2,}")
_CODE = re.compile(r"^msg(?:id|str|ctxt)\b|\w_\w|[{}=]|\(\)|\);|::|->|=>|^\s*[(\[]|[\"'`]\s*[,:)]|`")
_LABEL = re.compile(r"^\s*[^\W\d_]+(?: [^\W\d_]+)?\s*[:=]\s*")

_HEADER = re.compile(r"^(?:commit [0-9a-f]{7,}|Author: |AuthorDate: |Commit: |CommitDate: |Date: |Merge: |From [0-9a-f]{40} |From: |To: |-{20,}$|r\d+ \| |page-edit by |---$)")
_DIFF_START = re.compile(r"^(?:diff --git |Index: \S|--- a/|diff -)")
_DIFF_HEAD = re.compile(r"^(?:\+\+\+ |--- |diff |index |Index: |@@|={5,}|new file|deleted file|similarity |rename |old mode|new mode|Binary |GIT binary)")
_SUBJECT = re.compile(r"^Subject: (?:\[PATCH[^\]]*\]\s*)?")
_TRAILER = re.compile(r"^(?:[A-Z][\w-]+-(?:by|to|from|Id): |(?:Cc|Link|Bug|Refs?|Fixes|Closes): |\(cherry picked from)")


def parts(text: str) -> tuple[list[str], list[str], bool]:
    """(message lines, added lines, whether the text is laid out as a commit at all): without layout headers and trailers, and without added lines that only move or reformat removed ones."""
    message, added, removed = [], [], Counter()
    in_diff = laid_out = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if in_diff:
            if line[:1] == "+":
                if line[:4] != "+++ ":
                    added.append(line[1:])
            elif line[:1] == "-" and not line.startswith("--- "):
                removed["".join(line[1:].split())] += 1
        elif _DIFF_START.match(line):
            in_diff = laid_out = True
        elif _HEADER.match(line):
            laid_out = True
        else:
            line = _SUBJECT.sub("", line).strip()
            if line and not _TRAILER.match(line):
                message.append(line)
    if removed:
        fresh = []
        for line in added:
            bare = "".join(line.split())
            if removed.get(bare):
                removed[bare] -= 1
            else:
                fresh.append(line)
        added = fresh
    return message, [a for a in added if a.strip()], laid_out


def undisguise(line: str) -> str:
    """The line as it is meant: without zero-width characters, dotted letters, digits for letters and defanged addresses."""
    if _DISGUISE.search(line):
        line = _ZERO_WIDTH.sub("", line).replace("[.]", ".").replace("hxxp", "http").replace("hXXp", "http")
        line = _DOTTED.sub(lambda m: m[0].replace(". .", " ").replace("..", " ").replace(".", ""), line)
    return _LEET_WORD.sub(lambda m: m[0].translate(_LEET), line)


@dataclass(slots=True)
class Line:
    """What a line has: characters, whether it is code, links, whether all its words are link text, hashtags, fields, fields of several words, host, words."""

    size: int
    code: bool
    links: int
    anchored: bool
    tags: int
    fields: int
    multi: int
    host: str
    words: list[str]

    def packed(self) -> str:
        return "\t".join((str(self.size), "01"[self.code], str(self.links), "01"[self.anchored], str(self.tags), str(self.fields), str(self.multi), self.host, " ".join(self.words)))

    @classmethod
    def unpacked(cls, text: str) -> Line:
        size, code, links, anchored, tags, fields, multi, host, words = text.split("\t")
        return cls(int(size), code == "1", int(links), anchored == "1", int(tags), int(fields), int(multi), host, words.split())


def read_line(raw: str) -> Line:
    """The line, undisguised and without comment marks."""
    line = undisguise(_MARKS.sub("", raw.strip())).strip()
    low = line.lower()
    anchors = [(u, t) for u, t in _HTML_LINK.findall(line)] + [(u, t) for t, u in _MD_LINK.findall(line)] + [(u, t) for u, t in _BB_LINK.findall(line)]
    rest = _BB_LINK.sub(" ", _MD_LINK.sub(" ", _HTML_LINK.sub(" ", line))) if anchors else line
    urls = [u for u, _ in anchors] + _URL_RE.findall(rest)
    plain = _URL_RE.sub(" ", rest) if urls else rest
    bare = _TAGS.sub(" ", plain) if "<" in plain or "[" in plain else plain
    content = _CONTENT.search(low) if "<meta" in low else None
    shown = content[1] if content else (bare + " " + " ".join(t for _, t in anchors)).lower()
    words = _WORD.findall(shown)
    fields = [f for f in _SEPARATOR.split(_LABEL.sub("", shown).strip(" .|")) if f.strip()]
    host = "".join((_HOST.match(urls[0]) or [None, ""])[1].lower().split()) if urls else ""
    tags = len(_HASHTAG.findall(line)) if "#" in line else 0
    if tags < 0.8 * len(line.split()):
        tags = 0
    code = content is None and bool(_CODE.search(_LABEL.sub("", bare)))
    return Line(len(raw.strip()), code, len(urls), bool(anchors) and not _WORD.search(bare), tags, len(fields), sum(len(f.split()) > 1 for f in fields), host, words)


FIGURES = ("n_words", "top_word", "top_gram", "duplicates", "links", "separators")


def figures(lines: list[Line]) -> dict[str, float]:
    """The ratios of a part: top word and top pair of words, repeated lines, characters of lines with links, separators a word. Code has words by nature that repeat, so only other lines count."""
    prose = [x for x in lines if not x.code]
    distinct = {tuple(x.words) for x in prose}
    words = Counter(w for x in distinct for w in x)
    pairs = Counter(p for x in distinct for p in zip(x, x[1:], strict=False))
    n, size = sum(words.values()), sum(x.size for x in lines)
    return {
        "n_words": float(n), "top_word": max(words.values()) / n if n else 0.0, "top_gram": 2 * max(pairs.values(), default=0) / n if n else 0.0, "duplicates": 1 - len(distinct) / len(prose) if prose else 0.0,
        "links": sum(x.size for x in lines if x.links) / size if size else 0.0, "separators": sum(max(0, x.fields - 1) for x in prose) / n if n else 0.0,
    }


#: A part is promotional if so much of its characters is marked.
SHARE = 0.4
#: Function words stand in so large a share of a language's messages, common words in so large a one; learned for languages with so many messages, at most so
#: many words of each of the languages with the most messages. This bounds what the driver holds and sends: LANGUAGES x WORDS words.
FUNCTION_SHARE, COMMON_SHARE, TOP_SHARE, LEARN_FROM, LANGUAGES, WORDS = 0.04, 0.02, 0.065, 200, 100, 2000
#: Function words are missing below this part of the language's usual share of them, itself kept within two bounds.
TERSE, TERSE_LEAST, TERSE_MOST = 0.45, 0.1, 0.25
#: A heavy word is no common one, stands at least so often and makes so much of a part; so much of a line must be heavy words.
HEAVY_N, HEAVY, COVERED = 3, 0.06, 0.2
#: Lines of a link list and the share of different hosts among them; fields and words of a line of tags; words of a long line and its share of the most frequent words; words of a short page.
LINKS, HOSTS, FIELDS, TAG_WORDS, LONG, LONG_TOP, SHORT = 4, 0.6, 4, 6, 20, 0.12, (4, 20)


@dataclass
class Usual:
    """What is learned: function words, common words, the most frequent words, and per language its usual figures and share of function words."""

    function: frozenset[str] = FUNCTION_WORDS
    common: frozenset[str] = FUNCTION_WORDS
    top: frozenset[str] = FUNCTION_WORDS
    of: dict[str, dict[str, float]] = field(default_factory=dict)

    def terse(self, lang: str) -> float:
        return min(TERSE_MOST, max(TERSE_LEAST, TERSE * self.of.get(lang, {}).get("function", 0.5)))

    def beyond(self, lang: str, figure: str, value: float, by: float, most: float) -> bool:
        """Whether a figure is beyond what is usual in the language. The usual counts up to a bound, so that a language full of spam doesn't set its own standard."""
        return value >= min(self.of.get(lang, {}).get(figure, 0.0), most) + by


def _share(words: Iterable[str], among: frozenset[str] | set[str]) -> float:
    words = list(words)
    return sum(w in among for w in words) / len(words) if words else 0.0


def could_be_marked(lines: list[Line]) -> bool:
    """False only where no line can be marked whatever the language's words are: the conditions of ``marked_lines`` that don't depend on them."""
    prose = [x for x in lines if not x.code]
    if sum(x.links > 0 for x in lines) >= LINKS or any(x.tags >= 3 or len(x.words) >= LONG or (x.fields >= FIELDS and len(x.words) >= TAG_WORDS) for x in prose):
        return True
    if SHORT[0] <= sum(len(x.words) for x in prose) < SHORT[1] or len({tuple(x.words) for x in prose}) <= len(prose) - 2:
        return True
    words = Counter(w for x in {tuple(x.words) for x in prose} for w in x)
    n = sum(words.values())
    return any(c >= HEAVY_N and c >= HEAVY * n and not w.isdigit() for w, c in words.items())


def marked_lines(lines: list[Line], lang: str, part: str, usual: Usual) -> list[str]:
    """Per line why it is marked, or nothing: a list of links, stuffed with words, repeated, tags, long or short text without function words."""
    terse = usual.terse(lang)
    function = [_share(x.words, usual.function) for x in lines]
    common = [_share(x.words, usual.common) for x in lines]
    prose = [x for x in lines if not x.code]
    times = Counter(tuple(x.words) for x in prose)
    words = Counter(w for x in times for w in x)
    n = sum(words.values())
    heavy = {w for w, c in words.items() if c >= HEAVY_N and c >= HEAVY * n and w not in usual.common and not w.isdigit()}
    own = figures(lines)
    stuffed = usual.beyond(lang, "top_word", own["top_word"], 0.0, 0.06) or usual.beyond(lang, "top_gram", own["top_gram"], 0.02, 0.1)
    listed = usual.beyond(lang, "separators", own["separators"], 0.05, 0.1)
    repeated = usual.beyond(lang, "duplicates", own["duplicates"], 0.2, 0.3)
    linked = usual.beyond(lang, "links", own["links"], 0.1, 0.3)

    # a list of links to ever other hosts advertises, whatever they are called; one to a project's own host, or that explains them, serves it
    link = [x.links > 0 and not (x.code and not x.anchored) and f <= (0.5 if x.anchored else terse) for x, f in zip(lines, function, strict=True)]
    n_links = sum(link)
    if n_links < LINKS or len({x.host for x, k in zip(lines, link, strict=True) if k}) < HOSTS * n_links or not linked:
        link = [False] * len(lines)
    # a page of a few words that is no commit, in a language that is known, with hardly a word that is usual there
    plain = [w for x in prose for w in x.words if w.isalpha()]  # numbers and names of branches tell nothing
    short = part == "page" and lang in usual.of and SHORT[0] <= len(plain) <= n < SHORT[1] and not any(x.code or x.links for x in lines) and _share(plain, usual.common) <= 0.2
    out = []
    for x, f, c, k in zip(lines, function, common, link, strict=True):
        w, why = x.words, ""
        table = x.fields >= 3 and x.multi == 0  # fields of one word each are a table of data
        if k:
            why = "links"
        elif x.code or not w:
            why = ""
        elif stuffed and len(w) >= 3 and not table and c <= 0.5 and _share(w, heavy) >= COVERED:
            why = "stuffed"
        elif repeated and len(w) >= 3 and not table and f <= terse and times[tuple(w)] >= 3:
            why = "repeated"
        elif listed and x.fields >= FIELDS and x.multi >= 0.2 * x.fields and len(w) >= TAG_WORDS and f <= terse:
            why = "tags"
        elif x.tags >= 3 and c <= 0.3:
            why = "tags"
        elif len(w) >= LONG and _share(w, usual.top) <= LONG_TOP and max(Counter(v for v in w if len(v) > 3).values(), default=0) >= 3:
            why = "long"
        elif short:
            why = "short"
        out.append(why)
    return out


def marked_share(lines: list[Line], lang: str, part: str, usual: Usual) -> float:
    size = sum(x.size for x in lines)
    return sum(x.size for x, why in zip(lines, marked_lines(lines, lang, part, usual), strict=True) if why) / size if size else 0.0


_ROWS = "kind string, doc_id bigint, lang string, part string, word string, n bigint, m bigint, lines array<string>, " + ", ".join(f"{f} double" for f in FIGURES)
_ARROW = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("lang", pa.string()), ("part", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("m", pa.int64()), ("lines", pa.list_(pa.string())), *[(f, pa.float64()) for f in FIGURES]])
#: A task flushes its word counts beyond so many entries.
_FLUSH = 500_000


def part_figures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of two kinds: ``part``, the figures of every message (a page, if the text isn't laid out as a commit) and added text, with its lines if any could be marked; ``word``, how many messages (n) of a
    language have a word, and how often (m), counted per task; its null word counts the messages."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str | None], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [{"kind": "word", "lang": la, "word": w, "n": n, "m": m} for (la, w), (n, m) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, _ARROW)

        for b in batches:
            rows = []
            for i, la, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                message, added, laid_out = parts(t or "")
                for name, raw in (("message" if laid_out else "page", message), ("added", added)):
                    lines = [read_line(x) for x in raw]
                    if not lines:
                        continue
                    rows.append({"kind": "part", "doc_id": i, "lang": la, "part": name, "lines": [x.packed() for x in lines] if could_be_marked(lines) else None, **figures(lines)})
                    if name != "added":
                        seen = Counter(w for x in lines if not x.code for w in x.words)
                        seen[None] = sum(seen.values())
                        for w, m in seen.items():
                            at = held.setdefault((la, w), [0, 0])
                            at[0] += 1
                            at[1] += m
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            if len(held) > _FLUSH:
                yield flush()
        if held:
            yield flush()

    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(folded(F.col(lang)), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(make, _ROWS)


def learn(rows: DataFrame) -> Usual:
    """What is usual, from the rows of ``part_figures``: the words of at least COMMON_SHARE of a language's messages, and the medians of its messages' figures.

    The driver gets at most WORDS words of at most LANGUAGES languages.
    """
    words = rows.where("kind = 'word'").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    langs = words.where("word IS NULL").where(F.col("n") >= LEARN_FROM).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).select("lang", F.col("n").alias("of"), F.col("m").alias("all"))
    medians = rows.where("kind = 'part' AND part <> 'added' AND n_words > 0").groupBy("lang").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f) for f in FIGURES[1:]])
    of = {r["lang"]: {"all": float(r["all"]), "function": 0.0} | {f: float(r[f] or 0.0) for f in FIGURES[1:]} for r in langs.join(medians, "lang").collect()}
    if not of:
        return Usual()
    often = words.where(F.col("word").isNotNull() & F.col("lang").isin(list(of))).join(F.broadcast(langs), "lang").where(F.col("n") >= COMMON_SHARE * F.col("of"))
    best = often.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((F.col("n") / F.col("of")).alias("share"), "word", "m")), asc=False), 1, WORDS).alias("w"))
    function, common, top = set(FUNCTION_WORDS), set(FUNCTION_WORDS), set(FUNCTION_WORDS)
    counts: dict[str, Counter] = {}
    for r in best.collect():
        for w in r["w"]:
            common.add(w["word"])
            if w["share"] >= FUNCTION_SHARE:
                function.add(w["word"])
            if w["share"] >= TOP_SHARE:
                top.add(w["word"])
            counts.setdefault(r["lang"], Counter())[w["word"]] = w["m"]
    for la, own in of.items():
        own["function"] = sum(m for w, m in counts.get(la, {}).items() if w in function) / max(1.0, own.pop("all"))
    return Usual(frozenset(function), frozenset(common), frozenset(top), of)


def judged_parts(documents: DataFrame, share: float = SHARE, **columns) -> DataFrame:
    """(doc_id, lang, part, figures, marked, promotional) of every part; ``marked`` is the share of its characters in marked lines."""
    rows, _ = settle(part_figures(documents, **columns), "figures")
    usual = learn(rows)
    of_parts = rows.where("kind = 'part'").select("doc_id", "lang", "part", *FIGURES, "lines")
    keep = ["doc_id", "lang", "part", *FIGURES]

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked = [marked_share([Line.unpacked(x) for x in lines], la, part, usual) for la, part, lines in zip(b.column("lang").to_pylist(), b.column("part").to_pylist(), b.column("lines").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(marked, pa.float64())], names=[*keep, "marked"])

    schema = "doc_id bigint, lang string, part string, " + ", ".join(f"{f} double" for f in FIGURES) + ", marked double"
    some = spread(of_parts.where("lines IS NOT NULL")).mapInArrow(judge, schema)
    none = of_parts.where("lines IS NULL").select(*keep, F.lit(0.0).alias("marked"))
    return some.unionByName(none).withColumn("promotional", F.col("marked") >= share)


def promotional_documents(documents: DataFrame, **how) -> DataFrame:
    """The doc_id of every document whose message or added lines mostly advertise.

    Only what a commit adds or says counts: removed lines, context, headers and lines merely moved or reformatted don't. Whole texts are
    read; null and empty ones are never promotional. A null lang is 'und'; a null doc_id is dropped; rows of one doc_id count
    together; an empty table gives an empty result; other columns are never read. Each document is judged in maps over the rows, so
    no copy, source or language gathers in one task; a language's words are counted per task and merged, its figures from bounded sketches.
    """
    return judged_parts(documents, **how).where("promotional").select("doc_id").distinct()
