"""Secret scans: base patterns, and password guess cost for values in credential contexts.

The guess cost of a value is the least number of bits over all ways to cut it into words
(of a public vocabulary, ranked), dates, repeats, keyboard walks and brute-force spans, found
by dynamic programming.  Every value that the scan finds gets its cost.  Values
that stand in a credential context (a key such as ``pwd`` with a sign, a bearer header, the
password of a URL) and cost at least ``MIN_BITS`` are added as spans of kind ``guess``;
spans of the base patterns always stay, and an added span is never covered by them: where a
base pattern takes only part of a value, the whole value is added beside it.

Defined cases: a null or empty text has no spans; spans are whole matches (for ``assign``
key, sign and value) in code points with exclusive end; letters of keys match in either
ASCII case only; repeated rows get equal results; an empty table gives no rows; a very long
text or value is scanned as a whole; columns other than id and text are not read, so their
names cannot clash.
"""

from __future__ import annotations

import functools
import json
import math
import re
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import load, map_batches, replace_rows, set_column, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 44.0

#: Contexts of values: keys with a sign, bearer headers, passwords of URLs; the group that matched is the value.
#: A quoted value of a key goes to its quote, any other one to white space, a quote or a separator.
CONTEXT = re.compile(
    r"""(?:password|passwd|secret|token|api_?key|(?<![A-Za-z0-9])(?:pwd|pass|passphrase|pin|credentials?|auth|authorization|private_?key|access_?key|secret_?key|client_?id|passcode|login))"""
    r"""["']?\x20*(?:=>|[:=])\x20*(?:"(?:(?:bearer|basic)\x20+)?([^\s"]{6,})(?=")|'(?:(?:bearer|basic)\x20+)?([^\s']{6,})(?=')|["']?(?:(?:bearer|basic)\x20+)?([^\s"'<>,;]{6,}))"""
    r"""|(?:(?<![A-Za-z0-9])bearer\x20+|://[^\s:/@"']+:)([^\s"'<>,;@]{6,})""",
    re.I | re.A,
)
_HINTS = ("pwd", "pass", "pin", "credential", "auth", "key", "client", "login", "bearer", "://", "secret", "token")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A public vocabulary whose words, the commonest first, come after those below.
VOCABULARY = "word_bpe_49k.json"
#: Common words of passwords, the commonest first (fixed values).
WORDS = (
    "password the and you love iloveyou welcome monkey dragon master letmein login admin football baseball qwerty shadow sunshine princess "
    "superman batman michael jordan hunter soccer killer george charlie andrew daniel jessica thomas ashley summer winter spring autumn "
    "secret token user root test guest hello world server database default change changeme please access temp mypass pass word pwd key "
    "system oracle mysql postgres internet computer windows linux google apple orange banana cheese chocolate coffee pepper ginger flower "
    "freedom whatever trustno starwars matrix yankees dallas austin london paris berlin madrid tiger eagle falcon lion wolf bear dolphin "
    "horse cat dog correct battery staple red green blue black white yellow purple silver golden diamond crystal happy lucky angel baby "
    "family mother father brother sister friend forever always never monday friday january december production staging development example"
).split()
_LEET = str.maketrans("4@8310!57$", "aabeioists")
#: Rows of a keyboard (fixed values).
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Lengths of the units of repeats.
PERIODS = (1, 2, 3, 4)
_PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}([-/.]?)\d{1,2}\1(?:19|20)?\d\d|(?:19|20)\d\d([-/.]?)\d{1,2}\2\d{1,2}", re.A)


def _char_bits(c: str) -> float:
    if "0" <= c <= "9":
        return math.log2(10)
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    return math.log2(33) if c < "\x80" else math.log2(200)


def _near(a: str, b: str) -> bool:
    """Neighbours on a keyboard, or next to each other in the alphabet or the digits."""
    if abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum():
        return True
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q) and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and p != q


@functools.lru_cache(maxsize=2)
def ranks(vocabulary: str | None = None) -> tuple[dict[str, int], int]:
    """Rank of each word, and the length of the longest: ``WORDS``, then the whole words of a BPE vocabulary in order of their ids."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    words = [k[: len(k) - len(end)] for k, _ in sorted(model["vocab"].items(), key=lambda kv: kv[1]) if k.endswith(end)]
    found: dict[str, int] = {}
    for w in [*WORDS, *(w for w in words if len(w) > 2 and w.isascii() and w.isalpha())]:
        found.setdefault(w, len(found) + 1)
    return found, max(map(len, found))


#: Curves that are looked at one by one; more go to a tree.
FEW = 16


class Least:
    """The least, at places x that ascend, of curves  a + log2((x - i) / p + d)  entered in order of i.

    Of two curves the earlier one gains on the later one for ever, so a curve that an earlier one has reached is
    done: mostly one or two are left.  Should more than ``FEW`` stay, a tree over the places takes them, which keeps one curve in
    each node (the lesser one at its middle, as two curves cross at most once) and answers in time by its height.
    """

    def __init__(self, stop: int, p: int, d: float):
        self.stop, self.p, self.d = stop, p, d
        self.few: list[tuple[float, int]] = []
        self.held: dict[int, tuple[float, int]] | None = None

    def clear(self) -> None:
        self.few, self.held = [], None

    def _at(self, curve: tuple[float, int], x: int) -> float:
        return curve[0] + math.log2((x - curve[1]) / self.p + self.d)

    def add(self, a: float, i: int, since: int) -> None:
        """A curve that holds from the place ``since`` on."""
        if self.held is None:
            self.few.append((a, i))
            if len(self.few) > FEW:
                self.ask(since)
                if len(self.few) > FEW:
                    curves, self.few, self.held = self.few, [], {}
                    for curve in curves:
                        self._add(curve, since)
        else:
            self._add((a, i), since)

    def _add(self, curve: tuple[float, int], since: int) -> None:
        node, lo, hi = 1, 0, self.stop
        while lo < since <= hi:  # the right halves hold from ``since`` on as a whole
            mid = (lo + hi) // 2
            if since <= mid:
                self._enter(2 * node + 1, mid + 1, hi, curve)
                node, hi = 2 * node, mid
            else:
                node, lo = 2 * node + 1, mid + 1
        if lo >= since:
            self._enter(node, lo, hi, curve)

    def _enter(self, node: int, lo: int, hi: int, curve: tuple[float, int]) -> None:
        while lo <= hi:
            held = self.held.get(node)
            if held is None:
                self.held[node] = curve
                return
            mid = (lo + hi) // 2
            if self._at(curve, mid) < self._at(held, mid):
                self.held[node], curve, held = curve, held, curve
            if self._at(curve, lo) < self._at(held, lo):
                node, hi = 2 * node, mid
            elif self._at(curve, hi) < self._at(held, hi):
                node, lo = 2 * node + 1, mid + 1
            else:
                return
            if lo == hi and node not in self.held:
                self.held[node] = curve
                return

    def ask(self, x: int) -> float:
        if self.held is None:
            if len(self.few) == 1:
                return self._at(self.few[0], x)
            best, alive = math.inf, []
            for curve in self.few:
                v = self._at(curve, x)
                if v < best:
                    best = v
                    alive.append(curve)
            self.few = alive
            return best
        best, node, lo, hi = math.inf, 1, 0, self.stop
        while True:
            held = self.held.get(node)
            if held is not None:
                best = min(best, self._at(held, x))
            if lo >= hi:
                return best
            mid = (lo + hi) // 2
            node, lo, hi = (2 * node, lo, mid) if x <= mid else (2 * node + 1, mid + 1, hi)


@functools.lru_cache(maxsize=2)
def _finder(vocabulary: str | None = None) -> ahocorasick.Automaton:
    """All ranked words of three characters or more as one automaton: (length, bits of the rank)."""
    out = ahocorasick.Automaton()
    for w, r in ranks(vocabulary)[0].items():
        if len(w) > 2:
            out.add_word(w, (len(w), math.log2(r + 1)))
    out.make_automaton()
    return out


def _words(value: str, low: str, plain: str, vocabulary: str | None) -> dict[int, list[tuple[int, float]]]:
    """(start, bits) of the words that end at each place, in any case, with or without look-alikes."""
    found: dict[int, list[tuple[int, float]]] = {}
    finder = _finder(vocabulary)
    for text, extra in ((low, 0.0), (plain, 2.0)):
        if extra and plain == low:
            break
        for last, (size, bits) in finder.iter(text):
            i, j = last + 1 - size, last + 1
            case = 0.0 if value[i:j] == low[i:j] else 1.0 if value[i + 1 : j] == low[i + 1 : j] or value[i:j].isupper() else size / 2
            found.setdefault(j, []).append((i, bits + extra + case + 1.0))
    return found


_pair = functools.lru_cache(maxsize=1 << 16)(_near)
_bits_of = functools.lru_cache(maxsize=1 << 16)(_char_bits)
_DATE_CHARS = frozenset("0123456789-./")


def guess_bits(value: str, vocabulary: str | None = None) -> float:
    """Bits of the cheapest segmentation into words, dates, repeats, walks and brute-force characters.

    All starts of all spans count.  Words come from one pass of an automaton, dates have bounded lengths; for repeats and walks
    the least over the starts in a run is kept as few curves.  A start of a repeat that is left out cannot be the best: one
    after a brute-force character or a repeat of the run (an earlier start costs less), and any where a run of a divisor of the
    period goes as far back (its spans are cheaper).  A walk that costs more by now than a new one from here ever will is dropped.
    """
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    words = _words(value, low, plain, vocabulary)
    best, sums = array("d", bytes(8 * (n + 1))), array("d", bytes(8 * (n + 1)))
    turns = array("q", bytes(8 * (n + 1)))
    by = bytearray(n + 1)  # how the cheapest way to a place ends: 1 a brute-force character, 1 + p a repeat, 0 another span
    begin = {p: 0 for p in PERIODS}
    repeats = {p: Least(n, p, 1.0) for p in PERIODS}
    walk, walks, dates = 0, Least(n, 1, 0.0), 0
    total = cost = 0.0
    for j in range(1, n + 1):
        c = value[j - 1]
        bits = _bits_of(c)
        total += bits
        sums[j] = total
        cost, how = cost + bits, 1
        for i, more in words.get(j, ()):
            if best[i] + more < cost:
                cost, how = best[i] + more, 0
        dates = dates + 1 if c in _DATE_CHARS else 0
        if dates >= 4 and c.isdigit():
            for size in (4, 6, 7, 8, 9, 10):
                if size <= dates and _DATE.fullmatch(value[j - size : j]):
                    v = best[j - size] + (math.log2(120) if size == 4 else math.log2(365 * 120) + 2.0)
                    if v < cost:
                        cost, how = v, 0
        # repeats of a unit of p characters: at least two of them, and three characters
        for p in PERIODS:
            if j > p:
                if c != value[j - 1 - p]:
                    begin[p] = j - p
                    if repeats[p].few or repeats[p].held is not None:
                        repeats[p].clear()
                    continue
                if p > 1 and (begin[1] <= begin[p] or p == 4 and begin[2] <= begin[4]):
                    continue
                i = j - max(3, 2 * p)
                if i >= begin[p]:
                    least = repeats[p]
                    if i == begin[p] or by[i] != 1 and not (by[i] == 1 + p and i - max(3, 2 * p) >= begin[p]):
                        least.add(best[i] + sums[i + p] - sums[i], i, j)
                    v = least.ask(j)
                    if v < cost:
                        cost, how = v, 1 + p
        # walks over the keyboard, the alphabet or the digits, of three characters at least
        if j > 1:
            if not _pair(low[j - 2], low[j - 1]):
                walk = j - 1
                if walks.few or walks.held is not None:
                    walks.clear()
                turns[j] = turns[j - 1]
            else:
                turns[j] = turns[j - 1] + (j - walk > 2 and _turns(low[j - 3], low[j - 2], low[j - 1]))
                i = j - 3
                if i >= walk:
                    walks.add(best[i] + math.log2(47) - 2.5 * turns[i + 2] + 2.5, i, j)
                    v = walks.ask(j) + 2.5 * turns[j]
                    if v < cost:
                        cost, how = v, 0
                    if len(walks.few) > 3:
                        dear = cost - 2.5 * turns[j] + math.log2(47) + 3.5
                        walks.few = [w for w in walks.few if w[0] < dear]
        best[j] = cost
        by[j] = how
    return best[n]


def _turns(a: str, b: str, c: str) -> bool:
    """Whether a walk changes its direction at ``b``."""
    if ord(c) - ord(b) == ord(b) - ord(a):
        return False
    p, q, r = map(_PLACE.get, (a, b, c))
    return not (p and q and r) or (q[0] - p[0], q[1] - p[1]) != (r[0] - q[0], r[1] - q[1])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def all_spans(text: str, min_bits: float = MIN_BITS) -> list[tuple[str, int, int]]:
    """Base spans and values of credential contexts that are hard to guess and that base spans do not cover."""
    found = base_spans(text)
    low = text.lower()
    if not any(k in low for k in _HINTS):
        return found
    base = list(found)
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex > 2:  # no closing quote says where the value ends
            b = a + len(text[a:b].rstrip(".:!?)]}"))
        if b - a >= 6 and not _covered(a, b, base) and guess_bits(text[a:b]) >= min_bits:
            found.append(("guess", a, b))
    return sorted(found, key=_place)


def _covered(a: int, b: int, spans: list[tuple[str, int, int]]) -> bool:
    """Whether spans, in order of their starts, leave nothing of a to b."""
    for _, s, e in spans:
        if s <= a < e:
            a = e
    return a >= b


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS) -> DataFrame:
    """id and spans [(kind, start, stop, bits)] of every row; bits is the guess cost of the value. One narrow pass."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def columns(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in texts(batch):
            text = text or ""
            rows.append([{"kind": k, "start": a, "stop": b, "bits": guess_bits(_value(text[a:b], k))} for k, a, b in all_spans(text, min_bits)])
        return {"id": batch.column(0), "spans": rows}

    schema = f"id {own.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,stop:bigint,bits:double>>"
    return map_batches(own, schema, columns).withColumnRenamed("id", id_col)


def _value(match: str, kind: str) -> str:
    return ASSIGN.match(match)[2] if kind == "assign" else match


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans; beyond the contract the guessed spans, the assigned values that are easy to guess, and the bits of each span's value."""
    base = "filter(spans, s -> s.kind <> 'guess')"
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    weak = f"cast(size(filter(spans, s -> s.kind = 'assign' and s.bits < {MIN_BITS})) as bigint)"
    return scan(load(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"), F.expr(_joined("spans")).alias("spans"),
        count("guess"), F.expr(weak).alias("n_weak"), F.expr("array_join(transform(spans, s -> format_string('%.1f', s.bits)), ',')").alias("bits"),
    )


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span, or run of overlapping spans, becomes ``[REDACTED]``."""
    pieces, at = [], 0
    for _, a, b in spans:
        if a >= at:
            pieces += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*pieces, text[at:]])


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in them are redacted."""

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in texts(batch):
            spans = all_spans(text) if text else []
            out.append(redact(text, spans) if spans else text)
        if "n_chars" in batch.schema.names:
            batch = set_column(batch, "n_chars", [None if t is None else len(t) for t in out])
        return set_column(batch, "text", out)

    return replace_rows(docs, clean)
