"""Personal data in whole texts: fixed patterns, and a conditional random field for what they miss.

The patterns find plainly written e-mail addresses, IP addresses, card and phone numbers. They are found by
byte classes over a slice of texts at once, so a text of any length costs linear time: only runs of digits
and separators, and the surroundings of an ``@``, are looked at one by one. Around words that hold a digit,
an ``@`` or a spelled-out sign a linear-chain field over word shapes labels each word; a labelled run is
added if it can be such a thing (digits, Luhn sum, parts up to 255) and touches no other span. So
numbers that run into each other, local phone numbers and spelled-out addresses are added, and the
spans of the patterns always stay.

One pass over the texts without a shuffle; a task holds a slice of some megabytes.

Defined cases: null and empty texts have no span. Every row is judged by itself, so repeated rows get
equal answers. Offsets count code points. Other columns are carried in ``rest``. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onefold.llm.crf import fit as fit_chain
from onefold.llm.crf import viterbi
from onefold.llm.tokens import Words, slices, words_of

# Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

# Labels: 0 is outside, then first and further words of each kind.
LABELS = 1 + 2 * len(KINDS)
# Words looked at on either side of a word that may belong to personal data.
REACH = 3
# Labelled rows that are read at most.
MAX_LABELLED = 5_000
_CACHE = 200_000


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGITS = "0123456789"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NUMERIC = _mask(_DIGITS + ".()+- ")
_LOCAL = _mask(_DIGITS + _LETTERS + "._%+-")
_IS_DIGIT = _mask(_DIGITS)
_IS_SIGN = _mask(_DIGITS + "@")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A"):ord("Z") + 1] = ord("X")
_SHAPE[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = ord("x")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def _digits(text: bytes) -> str:
    return re.sub(rb"[^0-9]", b"", text).decode()


def number_spans(run: bytes) -> list[tuple[int, int, int]]:
    """Pattern spans (kind, start, end) of a run of digits and separators."""
    out = []
    for m in DOTTED.finditer(run) if run.count(b".") >= 3 else ():
        at, parts = m.start(), m.group().split(b".")
        for i in range(0, len(parts), 4):
            group = parts[i:i + 4]
            size = sum(map(len, group)) + len(group) - 1
            if len(group) == 4 and all(map(_small, group)):
                out.append((1, at, at + size))
            at += size + 1
    for m in CARD.finditer(run):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(run) if b"+" in run else ():
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def base_spans(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Pattern spans (kind, start, end) in bytes; texts lie end to end and no span crosses a bound."""
    if not len(data):
        return []
    inside = _NUMERIC[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    digits = np.concatenate(([0], np.cumsum(_IS_DIGIT[data])))
    some = np.flatnonzero(digits[end] - digits[begin] >= 4)
    out = []
    for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True):
        out.extend((k, a + i, a + j) for k, i, j in number_spans(data[a:b].tobytes()))
    signs = np.flatnonzero(data == ord("@"))
    if len(signs):
        other = np.flatnonzero(~_LOCAL[data])
        left = np.append(other, len(data))[np.searchsorted(other, signs) - 1] + 1
        left[np.searchsorted(other, signs) == 0] = 0
        text = np.searchsorted(bounds, signs, side="right") - 1
        raw, done = data.tobytes(), 0
        for at, a, lo, hi in zip(signs.tolist(), left.tolist(), bounds[text].tolist(), bounds[text + 1].tolist(), strict=True):
            a = max(a, lo, done)
            m = DOMAIN.match(raw, at + 1, hi) if a < at else None
            if m:
                out.append((0, a, m.end()))
                done = m.end()
    return out


# What a labelled run must hold to be added; the first match in the run counts.
_AT, _DOT = r"\s*(?:@|[(\[{]\s*at\s*[)\]}]|\bat\b)\s*", r"\s*(?:\.|[(\[{]\s*dot\s*[)\]}]|\bdot\b)\s*"
PLAUSIBLE = (
    re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]*[A-Za-z0-9])+", re.I),
    re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I),
    re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9])(?:\+|\(\+?)?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9])"),
)


def plausible(kind: int, text: str) -> tuple[int, int] | None:
    """Start and end, in the labelled run, of what can be personal data of the kind."""
    m = PLAUSIBLE[kind].search(text)
    if not m:
        return None
    digits = re.sub("[^0-9]", "", m.group())
    if kind == 1 and any(int(p) > 255 for p in re.findall("[0-9]+", m.group())):
        return None
    if kind == 2 and not luhn(digits):
        return None
    return m.start(), m.end()


# Words that announce or spell out personal data.
CUES = (
    "at (at) [at] {at} dot (dot) [dot] {dot} phone tel tel. tel: phone: telephone call fax fax: mobile mobile: cell telefon telefon: téléphone "
    "teléfono card card: visa mastercard amex credit karte tarjeta carte ip ip: host server address mail mail: email email: e-mail e-mail: "
    "contact write order id invoice date version room page isbn total"
).split()
_CUE_SET = frozenset(CUES)
_JUNK = "#&%$*!?,;:\"'<>|~^`=."
SPELLED = re.compile(rb"[(\[{](?:at|dot)[)\]}]|(?<![^ \t-\r])dot(?![^ \t-\r])|(?<![^ \t-\r])at[ \t-\r]+[a-z0-9-]+\.[a-z]{2}")


def shape(word: str) -> str:
    """Letters as X and x without repeats, runs of digits as their length."""
    out = re.sub(r"[^\W\d_A-Z]+", "x", re.sub("[A-Z]+", "X", word))
    return re.sub("[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", out)


def _digit_class(word: str) -> int:
    n = sum(c in _DIGITS for c in word)
    return int(np.searchsorted([0, 3, 4, 6, 7, 9, 11, 15, 19], n))


def word_features(word: str) -> tuple[list[str], list[str]]:
    """Features of a word for its own label, and for those of its neighbours."""
    core = word.strip(_JUNK)
    coarse = re.sub(r"d\d+", "d", shape(core))
    cue = word.lower() if word.lower() in _CUE_SET else core.lower() if core.lower() in _CUE_SET else ""
    plain = cue or (coarse if len(coarse) <= 8 else "long")
    own = [f"shape {shape(core)}", f"coarse {coarse}", f"digits {_digit_class(core)}", f"cue {cue}", f"ends {word[len(word.rstrip(_JUNK)):][:1]}"]
    if "@" in core:
        own.append("sign")
    return own, [plain, f"{_digit_class(core)}"]


def sequence_features(words: Sequence[str]) -> list[list[str]]:
    """Features per word, those of its neighbours included; the ends of a text are a neighbour of their own."""
    found = [word_features(w) for w in words]
    edge = ["end", "end"]
    out = []
    for i, (own, _) in enumerate(found):
        before = found[i - 1][1] if i else edge
        after = found[i + 1][1] if i + 1 < len(found) else edge
        out.append([*own, *(f"-{k} {x}" for k, x in enumerate(before)), *(f"+{k} {x}" for k, x in enumerate(after))])
    return out


@dataclass
class Field:
    """A fitted field: weights per feature name, transitions and start scores."""

    weights: dict[str, np.ndarray]
    transition: np.ndarray
    start: np.ndarray
    cache: dict = field(default_factory=dict, repr=False)

    def emission(self, features: Sequence[str]) -> np.ndarray:
        out = np.zeros(LABELS)
        for f in features:
            out += self.weights.get(f, 0.0)
        return out

    def word(self, key: int, word: bytes) -> np.ndarray:
        """Scores of a word: for its own label, for the label after it, for the label before it."""
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            own, beside = word_features(word.decode("utf-8", "replace"))
            got = np.concatenate([self.emission(own), *(self.emission([f"{s}{k} {x}" for k, x in enumerate(beside)]) for s in "-+")])
            self.cache[key] = got
        return got


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and first labels there may be: a further word only after one of its kind."""
    may = np.ones((LABELS, LABELS), bool)
    first = np.ones(LABELS, bool)
    for k in range(len(KINDS)):
        may[:, 2 + 2 * k] = False
        may[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        first[2 + 2 * k] = False
    return may, first


def gold_labels(text: str, spans: Sequence) -> tuple[list[str], list[int]]:
    """Words of a labelled text and their labels."""
    words, labels = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        words.append(m.group())
        label = 0
        for s in spans:
            if s["start"] < m.end() and m.start() < s["end"]:
                label = 1 + 2 * KINDS.index(s["kind"]) + (m.start() > s["start"])
        labels.append(label)
    return words, labels


def fit_field(labelled: DataFrame) -> Field:
    """Train on ``text`` and ``spans`` (kind, start, end in code points) of at most ``MAX_LABELLED`` rows."""
    names: dict[str, int] = {}
    rows, gold, first = [], [], [0]
    for r in labelled.select("text", "spans").orderBy("text").limit(MAX_LABELLED).collect():
        words, labels = gold_labels(r["text"] or "", r["spans"] or [])
        rows.extend([names.setdefault(f, len(names)) for f in fs] for fs in sequence_features(words))
        gold.extend(labels)
        first.append(len(gold))
    wide = max(map(len, rows), default=1)
    ids = np.full((len(rows), wide), len(names))
    for i, r in enumerate(rows):
        ids[i, :len(r)] = r
    may, starts = allowed()
    weights, transition, start = fit_chain(ids, len(names), np.array(gold, int), np.array(first), may, starts)
    return Field(dict(zip(names, weights, strict=True)), transition, start)


def _neighbourhoods(words: Words, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words to be labelled, and the bounds of their sequences."""
    signs = np.concatenate(([0], np.cumsum(_IS_SIGN[data])))
    lit = signs[words.end] > signs[words.start]
    for m in SPELLED.finditer(raw):
        lit[np.searchsorted(words.start, m.start(), side="right") - 1] = True
    at = np.flatnonzero(lit)
    if not len(at):
        return at, np.zeros(1, np.int64)
    text = np.searchsorted(words.first, at, side="right") - 1
    lo = np.maximum(at - REACH, words.first[text])
    hi = np.minimum(at + REACH + 1, words.first[text + 1])
    change = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    held = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    of = np.searchsorted(words.first, held, side="right") - 1
    cut = np.flatnonzero((np.diff(held) > 1) | (np.diff(of) > 0)) + 1
    return held, np.concatenate(([0], cut, [len(held)]))


def field_spans(model: Field, words: Words, raw: bytes) -> list[tuple[int, int, int]]:
    """Labelled runs (kind, start, end) in bytes that are plausible."""
    held, first = _neighbourhoods(words, words.data, raw)
    if not len(held):
        return []
    # One key per kind of word: the shape where it holds a digit or @, else the word in lower case.
    signs = np.concatenate(([0], np.cumsum(_IS_SIGN[words.data])))
    lit = signs[words.end] > signs[words.start]
    change = np.zeros(len(words.data) + 1, np.int8)
    change[words.start[lit]] += 1
    change[words.end[lit]] -= 1
    shaped = np.cumsum(change[:-1], dtype=np.int8) > 0
    keys = Words(np.where(shaped, _SHAPE[words.data], _LOWER[words.data]), words.start, words.end, words.first).hashes()
    text = np.searchsorted(words.first, held, side="right") - 1
    has_before, has_after = held > words.first[text], held + 1 < words.first[text + 1]
    need = np.unique(np.concatenate([held, held[has_before] - 1, held[has_after] + 1]))
    kinds, sample, place = np.unique(keys[need], return_index=True, return_inverse=True)
    scores = np.array([model.word(int(k), words.bytes_of(int(need[s]))) for k, s in zip(kinds, sample, strict=True)])
    where = np.empty(len(words.start), np.int64)
    where[need] = place
    edges = [model.emission([f"{s}{k} end" for k in range(2)]) for s in "-+"]
    emission = scores[where[held], :LABELS]
    emission = emission + np.where(has_before[:, None], scores[where[np.maximum(held - 1, 0)] * has_before, LABELS:2 * LABELS], edges[0])
    emission = emission + np.where(has_after[:, None], scores[where[np.minimum(held + 1, len(where) - 1)] * has_after, 2 * LABELS:], edges[1])
    label = viterbi(emission, first, model.transition, model.start)
    begins = np.flatnonzero(label % 2 == 1)
    further = (label > 0) & (label % 2 == 0)
    stop = np.append(np.flatnonzero(~further), len(label))
    ends = stop[np.searchsorted(stop, begins, side="right")]
    out = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        a, z = int(words.start[held[b]]), int(words.end[held[e - 1]])
        piece = raw[a:z].decode("utf-8", "replace")
        kind = int(label[b] - 1) // 2
        found = plausible(kind, piece)
        if found:
            out.append((kind, a + len(piece[:found[0]].encode()), a + len(piece[:found[1]].encode())))
    return out


def spans_of(texts: pa.Array, model: Field) -> list[list[tuple[int, int, int, bool]]]:
    """Per text the spans (kind, start, end, from a pattern) in code points, by kind and start."""
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(texts))]
    words = words_of(texts)
    if not len(words.data):
        return out
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    raw = _LOWER[words.data].tobytes()
    base = base_spans(words.data, bounds)
    taken = np.zeros(len(words.data), bool)
    for _, a, b in base:
        taken[a:b] = True
    spans = [(k, a, b, True) for k, a, b in base]
    for k, a, b in field_spans(model, words, raw):
        if not taken[a:b].any():
            taken[a:b] = True
            spans.append((k, a, b, False))
    if spans:
        points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
        at = np.array([s[1] for s in spans])
        # The last text that starts there: empty texts before it have the same bound.
        text = np.searchsorted(bounds, at, side="right") - 1
        for (k, a, b, fixed), t in zip(spans, text.tolist(), strict=True):
            zero = int(points[bounds[t]])
            out[t].append((k, int(points[a]) - zero, int(points[b]) - zero, fixed))
    for found in out:
        found.sort()
    return out


def _joined(spans: Sequence[tuple[int, int, int, bool]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


def _redacted(text: str, spans: Sequence[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the one that starts first."""
    parts, at = [], 0
    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join([*parts, text[at:]])


def personal_data(docs: DataFrame, model: Field, redact: bool = False) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found, redacted, rest``.

    The counts and ``base_sha256`` are of the patterns' spans, ``spans`` and ``found`` hold all. With ``redact`` the
    text with ``[KIND]`` in place of the spans is returned too, else ``redacted`` is null.
    """
    plain = Field(model.weights, model.transition, model.start)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("by_pattern", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                spans = spans_of(texts, plain)
                fixed = [[s for s in found if s[3]] for found in spans]
                columns = [part.column("doc_id")]
                columns += [pa.array([sum(s[0] == k for s in found) for found in fixed], pa.int64()) for k in range(len(KINDS))]
                columns += [
                    pa.array([sha256(_joined(found).encode()).hexdigest() for found in fixed], pa.string()),
                    pa.array([_joined(found) for found in spans], pa.string()),
                    pa.array([[{"kind": KINDS[k], "start": a, "end": b, "by_pattern": p} for k, a, b, p in found] for found in spans], pa.list_(one)),
                    pa.array([_redacted(t.as_py() or "", found) if redact else None for t, found in zip(texts, spans, strict=True)], pa.string()),
                    part.column("rest"),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "found array<struct<kind: string, start: bigint, end: bigint, by_pattern: boolean>>, redacted string, "
        f"rest {rows.schema['rest'].dataType.simpleString()}"
    )
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found", "redacted", "rest"]
    return rows.mapInArrow(run, schema)


# Forms of the labelled table: # is a digit, x a word of small letters. Every form stands in every frame of its kind.
FORMS = {
    "email": ["x@x.com", "x.x@x.org", "x.##@x#.x.com", "x at x dot com", "x [at] x [dot] org", "x(at)x.com", "x (at) x (dot) net",
              "x.x at x.com", "x @ x.com", "x at x dot co dot uk", "x_x[at]x.net", "x##@x-x.x", "x [at] x.com"],
    "ip": ["###.##.###.##", "##.###.#.##", "#.#.#.#", "###.###.###.###", "###[.]##[.]###[.]#", "##(.)##(.)##(.)##", "###.###.##.##:####",
           "## dot ## dot ### dot #"],
    "card": ["################", "#### #### #### ####", "####-####-####-####", "#### ###### #####", "###############", "####.####.####.####",
             "#################", "###################"],
    "phone": ["+# (###) ###-####", "(###) ###-####", "###-###-####", "+## ### #######", "+## ## #### ####", "###.###.####", "+##########",
              "+#-###-###-####", "(###)###-####", "(0##) #######", "+## (0)## #######", "# (###) ###-####", "#-###-###-####"],
}
FRAMES = ["x x {} x x", "x, x {}, x", "{} x x x", "X x x {}", "x {} {} x"]
CUED = {
    "email": ["mail: {} x", "write to {} or x", "contact {}."],
    "ip": ["server {} x x", "ip: {} x", "host {}, x"],
    "card": ["card: {} x", "visa {} x x", "credit card {}."],
    "phone": ["call {} x x", "tel: {} x", "phone {}, x", "fax: {}."],
}
# Numbers that need a word before them to be a phone number.
CUED_PHONES = ["##########", "0## #######", "### ####", "0### ######", "### ### ####", "## ## ## ## ##"]
OTHERS = [
    "x x ####-##-## x", "on ##.##.#### x", "at ##:##:## x x", "x ##:## x", "total #,###.## x", "x ##.##% x", "version #.#.# x", "x v##.#.## x",
    "order ######## x x", "id ########## x", "invoice ####/## x", "page ### x", "room ### x x", "x ### x", "x #### x", "x # x", "x ##, ##, ## x",
    "isbn ###-#-##-######-# x", "isbn ##########", "x = \"x##x#x##x####x\" x", "x ####x##x##x# x", "date ######## x", "x ##### x", "x #.# x",
    "x ######### x", "x ############ x x", "x ########### x", "## x ## x ## x", "#### - #### x", "x ####-#### x", "X x at x x", "x x, x. X x", "x x at X x x",
    "x dot x x", "x at ## x", "x ###### x", "x x@ x", "@x x x", "x #-# x", "x ##/##/#### x", "### ### ### x", "x ## ### ### x", "x$$$ x&&& x", "#x #x x",
    "x x x x x", "X X X!! X!!", "x #### #### x", "x #.## #.## #.## x", "x ######## x ######## x", "x ##-##-## x", "x ##.## x ##.## x",
]
_SYLLABLES = "an be co da er fi go hi in ka lo mi no ou pa re so ti un ve".split()


def _filled(form: str, draw: np.random.Generator) -> str:
    def one(m: re.Match) -> str:
        if m[0] == "#":
            return str(draw.integers(0, 10))
        word = "".join(draw.choice(_SYLLABLES) for _ in range(draw.integers(1, 4)))
        return word if m[0] == "x" else word.capitalize()

    return re.sub("#|(?<![A-Za-z])[xX](?![A-Za-z])", one, form)


def labelled_table(spark: SparkSession) -> DataFrame:
    """Some 500 short texts with their spans, made by rule from the forms and frames above."""
    draw = np.random.default_rng(12)
    rows = []

    def add(frame: str, kind: str | None, form: str = "") -> None:
        text, spans = "", []
        for i, part in enumerate(frame.split("{}")):
            if i:
                value = _filled(form, draw)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            text += _filled(part, draw)
        rows.append((text, spans))

    for kind, forms in FORMS.items():
        for form in forms:
            for frame in [*FRAMES, *CUED[kind]]:
                add(frame, kind, form)
    for form in CUED_PHONES:
        for frame in CUED["phone"]:
            add(frame, "phone", form)
        add("x x {} x x".format(form), None)
    for form in OTHERS * 3:
        add(form, None)
    return spark.createDataFrame(rows, "text string, spans array<struct<kind: string, start: int, end: int>>")
