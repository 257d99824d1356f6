"""Secret scans by assignment-aware lexing.

Three base patterns find credential shapes anywhere. Around them, a lexer reads what looks like source or configuration
syntax into name-literal pairs:

- assignments: ``name = "literal"``, ``name: literal``, ``name: type = literal``, ``name := literal``, ``"name" => 'literal'``,
  ``call("name", "literal")``; strings with prefixes, triple quotes, escapes and back-quotes; ``${NAME:-literal}``;
- strings put together by operators or side by side, over lines where brackets or operators say so: one literal of parts;
- block scalars of YAML, of which each line is a part, and XML elements, ``<name>literal</name>``;
- nesting: a name that says nothing (``value``) stands under that of the mapping around it, and a ``name``/``key`` entry
  names the ``value`` entry after it.

A literal that is itself a name bound in the text (``x``, ``$x``, ``${x}``) stands for that name's literal, through any
number of steps: the last one bound before, or else the next. Pairs in comments are judged like others, as a secret in a
comment is given away all the same, but bind no name. Each literal is then scored by how sensitive the names are that it
ends up under and by its own shape; those above the threshold are reported where the literal stands.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import packed, small_batches, unpacked

KINDS = ("assign", "access", "hex", "lex")
SPAN = "struct<kind string, start long, end long, secret_start long, score double, name string>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of [0-9a-f]+ that is shorter would be dropped
ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

OPERATOR = re.compile(r"[=:]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+")
# no part of these has a bound, and none is tried twice at a place
LEAD = re.compile(r"[=>]?[\x20\t]*+(?:\([\s(]*+)?")
STRING = re.compile(r"""(?:[rRbBuUfF]{1,2}|[@$])?(?:\"""(.*?)\"""|\'\'\'(.*?)\'\'\'|"((?:[^"\\\n]++|\\[^\n])*+)"|'((?:[^'\\\n]++|\\[^\n])*+)'|`([^`\n]*+)`)""", re.DOTALL)
RAW = re.compile(r"""\$\{[A-Za-z0-9_.\-]++\}|[^\s"',;(){}\[\]<>]""")
DEFAULT = re.compile(r"""\$\{[A-Za-z0-9_.\-]++:?-([^\s}"']++)\}""")  # a NAME takes the dash that follows it, so the colon has to be there or the name ends before
RUN = re.compile(r"""[^\s"',;(){}\[\]<>]++""")
#: Between the parts of a literal: an operator, over lines if need be, or nothing; inside brackets any white space.
JOIN = re.compile(r"\s*+(\+|\|\||&|\.\.|\.|~)\s*+|(?:[\x20\t]|\\\n)*+")
JOIN_INSIDE = re.compile(r"\s*+(\+|\|\||&|\.\.|\.|~)?\s*+")
PART_NAME = re.compile(r"\$?([A-Za-z_][A-Za-z0-9_.]*+)(?!\()")
BLOCK = re.compile(r"[\x20\t]*+[|>][+\-0-9]*+[\x20\t]*+(?:#[^\n]*+)?\n")
LINE = re.compile(r"([\x20\t]*+)([^\n]*+)\n?")
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?>(?:<!\[CDATA\[([^<>]++)(?<=\]\])>|([^<>]++))</\1\s*+>")
CALL = re.compile(r"""\([\x20\t]*+["']([A-Za-z_][A-Za-z0-9_.\-]*+)["'][\x20\t]*+,[\x20\t]*+(?:"((?:[^"\\\n]++|\\[^\n])*+)"|'((?:[^'\\\n]++|\\[^\n])*+)')""")
#: Operators inside a quoted literal of up to so many characters are part of it; longer ones may be two stray quotes of a long line, so these are read as well.
CLOSED = 4096
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.\-]*+)\}?")
#: What stands between ``name:`` and ``=`` in source with types: words, joined by ``|``, ``&`` or commas.
TYPE = re.compile(r"""[\x20\t]*+(?:&(?:'[a-z_]+\x20+)?(?:mut\x20+)?)?[A-Za-z0-9_.:?*\[\]<>"']++(?:[\x20\t]*+[|,&][\x20\t]*+[A-Za-z0-9_.:?*\[\]<>"']++)*+[\x20\t]*+""")
#: What begins a line that is a comment, and block comments.
COMMENT_LINES = ("#", "//", "--", ";", "*", "%", "'")
COMMENT_BLOCKS = (("/*", "*/"), ("<!--", "-->"))
#: Names that say nothing of what they hold, and entries that name the entry after them.
HOLDERS = {"value", "val", "default", "data", "content", "string", "text", "plain", "raw", "literal"}
NAMERS = {"name", "key", "id", "field", "variable", "property"}
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How sensitive a target is by a word of its name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "creds": 0.9, "bearer": 0.8, "auth": 0.7, "authorization": 0.7,
}
#: Words that make a `key` a sensitive one.
KEY_WORDS = {"api", "access", "private", "secret", "signing", "encryption", "auth", "account", "master", "service", "client", "ssh", "aws"}
NAME_STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "bearer", "auth")
PLACEHOLDER = re.compile(r"(?i)change.?me|example|placeholder|your[_-]|dummy|redacted|xxxx|\*\*\*|://|\s")
#: Characters less one of the longest of them.
OVERLAP = 10
NO_LITERAL = re.compile(r"(?i)(?:none|null|true|false|undefined)$|os\.environ|process\.env|getenv")


def name_weight(name: str) -> float:
    """0 to 1: how sensitive a target of this name is."""
    words = [w.lower() for w in CAMEL.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if ("key" in words or "keys" in words) and KEY_WORDS & set(words):
        best = max(best, 0.9)
    if "apikey" in "".join(words):
        best = 1.0
    return best


def literal_weights(text: str, literals: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """0 to 1 for each literal (start, end): how much it looks like a secret rather than a word, path or placeholder.

    Literals that end together (``a=b=c``) are counted from the shortest on, so each character is counted once.
    """
    out, end = {}, None
    for b, a in sorted(((b, a) for a, b in literals), key=lambda x: (x[0], -x[1])):
        if b != end:
            end, at, found, counts = b, b, False, Counter()
        found = found or PLACEHOLDER.search(text, a, min(b, at + OVERLAP)) is not None
        counts.update(text[a:at])
        at = a
        out[a, b] = 0.0 if found or b - a < 8 or NO_LITERAL.match(text, a, b) else _shape_weight(counts, b - a)
    return out


def _shape_weight(counts: Counter, n: int) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), any(not c.isalnum() for c in counts)))
    if kinds < 2 or entropy < 2.5:
        return 0.0
    if not any(c.isdigit() for c in counts):
        return 0.5 if kinds >= 3 and entropy >= 3.0 else 0.0
    return min(1.0, 0.4 + entropy / 8 + 0.1 * kinds)


def base_spans(text: str) -> list[tuple]:
    """(kind, start, end, start of the secret, score, name) of the base patterns, leftmost and non-overlapping by kind."""
    found: list[tuple] = []
    low = text.lower()
    if any(s in low for s in ASSIGN_STEMS):
        found += [("assign", m.start(), m.end(), m.start(2), 1.0, m[1]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), 1.0, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), m.start(), 1.0, None) for m in HEX.finditer(text)]
    return found


def target(text: str, at: int) -> str | None:
    """The whole name that stands before the operator at a position, possibly in quotes or brackets."""
    e = at - (text[at - 1 : at] == "\n")
    e -= text[e - 1 : e] in (":", "=", "+", "?")
    while e and text[e - 1] in " \t":
        e -= 1
    for _ in range(2):
        e -= text[e - 1 : e] in ('"', "'", "]")
    s = e
    while s and text[s - 1] in NAME_CHARS:
        s -= 1
    name = NAME.search(text, s, e)
    return name and name[0]


@dataclass
class Pair:
    """A name and its literal: the spans of its parts, the names among them, and where its value ends."""

    name: str
    parts: list[tuple[int, int]]
    refs: list[str]
    end: int
    plain: bool = True  # one span that may itself be a name
    binds: bool = True


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The lines of a literal without the white space around them; lines that only fence (``-----BEGIN``) are left out."""
    out, at = [], a
    while at < b:
        end = text.find("\n", at, b)
        end = b if end < 0 else end
        s, e = at, end
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s and not text.startswith("-----", s, e):
            out.append((s, e))
        at = end + 1
    return out


class Lexer:
    """The name-literal pairs of one text, by position."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.run, self.run_end = 0, 0  # a run is measured once, however many operators are in it
        self.comments = self._comment_blocks()
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.line = -1
        self.look(0)

    def look(self, at: int) -> bool:
        """Goes to the line of a position: how far its first word is in, and whether that begins a comment. False on the same line."""
        k = bisect_right(self.lines, at) - 1
        if k == self.line:
            return False
        text, self.line, start = self.text, k, self.lines[k]
        word = start
        while text[word : word + 1] in (" ", "\t"):
            word += 1
        self.is_comment, self.word = text.startswith(COMMENT_LINES, word), word
        while text[word : word + 1] in (" ", "\t", "-"):
            word += 1
        self.indent = word - start
        return True

    def _comment_blocks(self) -> list[tuple[int, int]]:
        out = []
        for opens, closes in COMMENT_BLOCKS:
            at = self.text.find(opens)
            while at >= 0:
                end = self.text.find(closes, at + len(opens))
                if end < 0:
                    break
                out.append((at, end))
                at = self.text.find(opens, end)
        return sorted(out)

    def commented(self, at: int) -> bool:
        """Whether a position is in a comment."""
        self.look(at)
        k = bisect_right(self.comments, (at, len(self.text))) - 1
        return k >= 0 and at < self.comments[k][1] or self.is_comment and self.word < at

    def value(self, name: str, at: int) -> Pair | None:
        """The pair whose literal begins after an operator."""
        text = self.text
        lead = LEAD.match(text, at)
        p, join = lead.end(), JOIN_INSIDE if "(" in lead[0] else JOIN
        parts, refs, plain = [], [], False
        if s := STRING.match(text, p):
            parts, p, plain = self._string(s), s.end(), True
        elif d := DEFAULT.match(text, p):
            return Pair(name, [d.span(1)], [], d.end(), False)
        elif r := RAW.match(text, p):
            a, b = r.span()
            if b == a + 1:
                if not self.run <= a < self.run_end:
                    self.run, self.run_end = RUN.match(text, a).span()
                b = self.run_end
            word = PART_NAME.match(text, a, b)
            if not word or word.end() < b - 1 or text[word.end() : b] not in ("", "+") or not STRING.match(text, (j := join.match(text, word.end())).end()) or not j[1]:
                return Pair(name, [(a, b)], [], a)
            refs, p = [word[1]], word.end()
        else:
            return None
        while True:
            j = join.match(text, p)
            if s := STRING.match(text, j.end()):
                parts, p, plain = parts + self._string(s), s.end(), False
            elif j[1] and j[1] != "." and (r := PART_NAME.match(text, j.end())):
                refs, p, plain = [*refs, r[1]], r.end(), False
            else:
                break
        return Pair(name, parts, refs, p, plain and len(parts) == 1)

    def _string(self, s: re.Match) -> list[tuple[int, int]]:
        a, b = s.span(s.lastindex)
        return _lines(self.text, a, b) if s.lastindex < 3 else [(a, b)] if b > a else []

    def block(self, name: str, at: int, indent: int) -> Pair | None:
        """The pair whose literal is a block scalar: the lines after its mark that stand further in than its name."""
        mark = BLOCK.match(self.text, at)
        if not mark:
            return None
        a = b = mark.end()
        while line := LINE.match(self.text, b):
            if line[2].strip() and len(line[1]) <= indent or line.end() == b:
                break
            b = line.end()
        return Pair(name, _lines(self.text, a, b), [], a, False)

    def assignments(self) -> Iterator[Pair]:
        text, after, colon = self.text, 0, None
        above: list[tuple[int, str]] = []  # mappings that are open, by indentation
        for op in OPERATOR.finditer(text):
            at = op.start()
            if at < after or text[at + 1 : at + 2] == "=" and text[at] == "=" or text[at - 1 : at] in ("!", "<", ">", "=") or text.startswith("//", at + 1):
                continue  # inside a literal, a comparison, a URL
            if self.look(at):
                while above and above[-1][0] >= self.indent:
                    above.pop()
            indent = self.indent
            typed = None
            if text[at] == "=":
                if colon is not None and TYPE.fullmatch(text, colon + 1, at):
                    typed = target(text, colon)
                colon = None
            elif ":" not in (text[at - 1 : at], text[at + 1 : at + 2]):
                colon = at
            name = target(text, at) or typed
            if not name:
                continue
            binds = not self.commented(at)
            own = f"{above[-1][1]}.{name}" if above and name.lower() in HOLDERS else name
            pair = (self.block(own, at + 1, indent) if text[at] == ":" else None) or self.value(own, at + 1)
            if pair is None or not pair.parts and not pair.refs:
                opened = LEAD.match(text, at + 1).end()
                if text[opened : opened + 1] in ("{", "[", "(", "\n", "\r"):
                    above.append((indent, name))
                continue
            pair.binds = binds
            yield pair
            if typed and typed != name:
                yield Pair(typed, pair.parts, pair.refs, pair.end, pair.plain, binds)
            if pair.end > pair.parts[0][0] if pair.parts else pair.refs:
                first = pair.parts[0][0] if pair.parts else at
                if pair.end - first <= CLOSED + 2:
                    after = pair.end

    def pairs(self) -> list[Pair]:
        """All pairs by position, and those of an entry that names the next."""
        found = list(self.assignments())
        more = []
        for m in ELEMENT.finditer(self.text) if "</" in self.text else ():
            a, b = m.span(m.lastindex)
            if parts := _lines(self.text, a, b - 2 * (m.lastindex == 2)):
                more.append(Pair(m[1], parts, [], m.end(), len(parts) == 1))
        for m in CALL.finditer(self.text):
            a, b = m.span(m.lastindex)
            if b > a and m.lastindex > 1:
                more.append(Pair(m[1], [(a, b)], [], m.end()))
        if more:
            for x in more:
                x.binds = not self.commented(x.parts[0][0])
            found = sorted(found + more, key=lambda x: x.parts[0][0] if x.parts else x.end)
        out = []
        for k, x in enumerate(found):
            out.append(x)
            last = found[k - 1] if k else None
            if last and x.name.rpartition(".")[2].lower() in HOLDERS and last.name.lower() in NAMERS and last.plain:
                a, b = last.parts[0]
                if NAME.fullmatch(self.text, a, b):
                    out.append(Pair(self.text[a:b], x.parts, x.refs, x.end, x.plain, x.binds))
        return out


def _resolved(text: str, found: list[Pair]) -> tuple[list[int], list[list[int]]]:
    """For each pair the one whose literal it stands for, and for the names among its parts theirs."""
    bound: dict[str, list[int]] = {}
    for i, x in enumerate(found):
        if x.binds:
            bound.setdefault(x.name, []).append(i)

    def of(name: str, i: int) -> int | None:
        """The last pair that binds a name before the i-th, or else the next."""
        at = bound.get(name, ())
        k = bisect_left(at, i)
        if k:
            return at[k - 1]
        k += k < len(at) and at[k] == i
        return at[k] if k < len(at) else None

    to = list(range(len(found)))
    for i, x in enumerate(found):
        if x.plain and (ref := REFERENCE.fullmatch(text, *x.parts[0])) and (j := of(ref[1], i)) is not None:
            to[i] = j
    state, circular = [0] * len(found), set()  # 1: on the way, 2: known
    for i in range(len(found)):
        way = []
        while not state[i]:
            state[i] = 1
            way.append(i)
            i = to[i]
        if state[i] == 1:  # a circle stands for nothing but what is written
            k = way.index(i)
            for j in way[k:]:
                to[j], state[j] = j, 2
            circular.update(way[k:] if len(way) > k + 1 else ())
            way = way[:k]
        for j in reversed(way):
            to[j], state[j] = to[i], 2

    def part(name: str, i: int) -> list[int]:
        """The pair whose literal a name among a literal's parts stands for; none if it ends in a circle or an unbound name."""
        j = of(name, i)
        r = None if j is None or j == i else to[j]
        return [] if r is None or r in circular or found[r].plain and text.startswith("$", found[r].parts[0][0]) else [r]

    return to, [[j for name in x.refs for j in part(name, i)] for i, x in enumerate(found)]


def lexed_spans(text: str, threshold: float) -> list[tuple]:
    """Spans of literals that end up under a sensitive name, with constants propagated."""
    low = text.lower()
    if not any(s in low for s in NAME_STEMS):
        return []
    found = Lexer(text).pairs()
    stands, refs = _resolved(text, found)
    weights: dict[int, tuple[float, str]] = {}  # by pair: the heaviest name that it ends up under
    for i, x in enumerate(found):
        if weight := name_weight(x.name):
            r = stands[i]
            # bound later only: it may be a literal that looks like that name
            for k in {r, i} if r > i and not text.startswith("${", x.parts[0][0]) else {r}:
                if weight > weights.get(k, (0.0,))[0]:
                    weights[k] = (weight, x.name)
    whole = lambda x: len(x.parts) == 1 and not x.refs
    shapes = literal_weights(text, {found[i].parts[0] for i in weights if whole(found[i])})
    shown: dict[int, tuple[float, str]] = {}  # by pair: the score under which its parts are reported
    for i, (weight, name) in weights.items():
        x = found[i]
        shape = shapes[x.parts[0]] if whole(x) else _joined_shape(text, [x.parts, *(found[j].parts for j in refs[i])])
        if (score := weight * shape) >= threshold:
            for j in (i, *refs[i]):
                if score > shown.get(j, (0.0,))[0]:
                    shown[j] = (score, name)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for i, (score, name) in shown.items():
        for part in found[i].parts:
            if score > best.get(part, (0.0,))[0]:
                best[part] = (score, name)
    return [("lex", a, b, a, s, n) for (a, b), (s, n) in best.items()]


def _joined_shape(text: str, pieces: list[list[tuple[int, int]]]) -> float:
    """The weight of a literal of several parts: that of what they make together; a placeholder in one spoils it."""
    counts, n = Counter(), 0
    for parts in pieces:
        for a, b in parts:
            if PLACEHOLDER.search(text, a, b):
                return 0.0
            counts.update(text[a:b])
            n += b - a
    return 0.0 if n < 8 else _shape_weight(counts, n)


def _outside(spans: list[tuple], base: list[tuple]) -> list[tuple]:
    """The spans that lie in none of the base, by one sweep over both in order."""
    base, out, k, reach = sorted(base, key=lambda x: x[1]), [], 0, -1
    for x in sorted(spans, key=lambda x: x[1]):
        while k < len(base) and base[k][1] <= x[1]:
            reach = max(reach, base[k][2])
            k += 1
        if x[2] > reach:
            out.append(x)
    return out


def find_secrets(text: str | None, threshold: float = 0.5) -> list[tuple]:
    """All spans of a text, by start and then kind. What the lexer adds lies in no base span."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + _outside(lexed_spans(text, threshold), base), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def spans_of(text: Column, threshold: float = 0.5) -> Column:
    """``array<SPAN>`` of a text column."""
    fields = ("kind", "start", "end", "secret_start", "score", "name")

    @F.pandas_udf(f"array<{SPAN}>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(fields, x)) for x in find_secrets(t, threshold)] for t in texts])

    return scan(text)


def scan_secrets(docs: DataFrame, *, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, spans`` and the columns named in ``keep``: every secret of every whole text, in code points, end exclusive.

    Null and empty texts have no spans. Repeated rows and ties are scanned alike, each for itself; a null id is kept.
    A text is lexed in one pass whose memory grows with that text only. Other columns are ignored, whatever their names; a kept column
    with the name of a result is returned as ``kept_<name>``.
    """
    small_batches(docs.sparkSession)
    d = packed(docs, ("doc_id", "text"), keep).withColumn("spans", spans_of(F.col("text"), threshold))
    return d.select("doc_id", *unpacked([c for c in keep if c != "doc_id"], ("doc_id", "text"), ("doc_id", "spans")), "spans")


def redact(docs: DataFrame, *, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``mask`` (names and operators stay), and n_chars, where there is one, made true."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, threshold, mask) for t in texts], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def _masked(text: str | None, threshold: float, mask: str) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for _, _, end, start, _, _ in sorted(find_secrets(text, threshold), key=lambda x: (x[3], -x[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:] if out else text


def digest_columns(spans: Column) -> list[Column]:
    """n_assign, n_access, n_hex, base_sha256 and spans (as text) of an ``array<SPAN>``."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"] != "lex")
    return [*map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans")]
