"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans follow fixed patterns and always stay. Wider patterns propose further spans (parts of a
run that failed as a whole, numbers without country code, spelled-out and unusual addresses, IPv6,
cards of 13 to 15 digits or with other separators). On every candidate, base ones included, seven
labelers give a graded vote from 0, strongly against, over 2, none, to 4, strongly for: strict shape,
check rules, gazetteers (classes of top domains, issuers with their lengths, country codes), words of
context by their distance, neighbouring characters, separator style, filler digits. A candidate is then
its kind, its votes and its shape, one of a bounded set of patterns, so that one aggregation over all
documents gives the counts of all patterns. On those counts expectation-maximisation estimates each
labeler's reliability, and a logistic classifier over kind, votes and shape is trained on the posterior. A proposed span is added if it is accepted and overlaps no span before it
(base spans first, then by probability, then leftmost).

Scanning is linear in the text, also over long runs of digits or letters, and deciding is one search
among the kept spans for each candidate. Offsets are code
points, ends exclusive. Defined cases: a null text is an empty one; texts of any length are
scanned whole; rows without an id and repeated rows get a result each; further columns, whatever their
names, are ignored (and kept by ``redact``); a table without any candidate adds no spans; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import staged, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "rule", "gazetteer", "context", "neighbours", "separators", "filler")
LEVELS = 5
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGIT_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS_RUN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_DIGIT = re.compile("[0-9]")
GROUP = re.compile(r"[0-9]++")
NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
PLUS_SHAPE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
WIDE_DOMAIN = re.compile(r"@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
SPELLED = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63} ?(?:[(\[{] ?(?:at|@) ?[)\]}]| at ) ?[\w-]{1,63}(?:(?: ?[(\[{] ?(?:dot|\.) ?[)\]}] ?| dot |\.)[\w-]{1,63})+(?![\w-])", re.I)
SPELLED_SIGN = re.compile(r"[(\[{ ](?:at|@)[)\]} ]", re.I)
LAST_LETTERS = re.compile(r"[^\W\d_]*\Z")
MARKS = re.compile(r"[^0-9]+")
BRACKET_DOTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
SIXES = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])")
OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:([./_]| - |  )[0-9]{4})(?:\1[0-9]{4}){2}(?![0-9])")
SHORT_CARD = re.compile(r"(?<![0-9.+-])3[0-9]{3}([\x20-]?)[0-9]{6}\1[0-9]{4,5}(?![0-9])")
ABROAD = re.compile(r"(?<![0-9+./-])00[1-9][0-9]{0,2}[\x20.-](?:\(0\))?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])")
AREA = re.compile(r"(?<![0-9+./-])(?:\(0[0-9]{1,4}\)[\x20-]?|0[0-9]{1,4}[\x20/-])[0-9]{3,8}(?:[\x20-][0-9]{2,5}){0,2}(?![0-9])")
STRICT = {
    "email": re.compile(r"\w[\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}"),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|[0-9A-Fa-f:]+"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([\x20.-])[0-9]{4})(?:\1[0-9]{4}){2}|3[0-9]{3}([\x20-])[0-9]{6}\2[0-9]{4,5}"),
    "phone": re.compile(r"(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20./-]?[0-9]{2,8}){1,4}"),
}
# Fixed values.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co dev app".split())
COUNTRY_DOMAINS = frozenset("us uk ca au de fr es it nl be ch at se no dk fi pl pt ie jp cn kr in br mx ru eu nz za cz hu gr tr il ar cl".split())
ISSUERS = {"4": (13, 16, 19), "51": (16,), "52": (16,), "53": (16,), "54": (16,), "55": (16,), "2221": (16,), "23": (16,), "24": (16,), "25": (16,), "26": (16,), "270": (16,), "34": (15,), "37": (15,), "6011": (16, 19), "62": (16, 17, 18, 19), "64": (16, 19), "65": (16, 19), "35": (16, 19), "36": (14, 19), "38": (14, 19)}
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "351", "353", "358", "420")
FOR = {
    "email": frozenset("email e-mail mail mailto contact write address courriel correo".split()),
    "ip": frozenset("ip host server address from client login addr".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact telefon téléphone teléfono".split()),
}
AGAINST = frozenset("version release build isbn issn section chapter figure table page revision order invoice serial part model".split())
WORD_BEFORE = re.compile(r"[^\W\d_][\w-]*")
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at)):
            found.append(("email", start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if not ANY_DIGIT.search(text):
        return found
    if "." in text:
        for run in DOTTED.finditer(text):
            parts = [(m[0], run.start() + m.start(), run.start() + m.end()) for m in GROUP.finditer(run[0])] if run[0].count(".") > 2 else []
            for i in range(0, len(parts) - 3, 4):
                if all(_small(p) for p, _, _ in parts[i : i + 4]):
                    found.append(("ip", parts[i][1], parts[i + 3][2]))
    for run in DIGIT_RUN.finditer(text):
        if 16 <= run.end() - run.start() <= 37 and 16 <= len(digits := _digits(run[0])) <= 19 and luhn(digits):
            found.append(("card", run.start(), run.end()))
    if "+" in text:
        for run in PLUS_RUN.finditer(text):
            if 8 <= len(_digits(run[0])) <= 15:
                found.append(("phone", run.start(), run.end()))
    return found


def proposed_spans(text: str) -> list[tuple[str, int, int]]:
    """Wider candidates; they may repeat or overlap base spans."""
    found: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in LOCAL or text[start - 1].isalnum()):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and (domain := WIDE_DOMAIN.match(text, at)):
            found.append(("email", start, domain.end()))
        done = at + 1
        at = text.find("@", done)
    if SPELLED_SIGN.search(text):
        found += [("email", m.start(), m.end()) for m in SPELLED.finditer(text)]
    if not ANY_DIGIT.search(text):
        return found
    if "." in text:
        for run in DOTTED.finditer(text):
            parts = [(m[0], run.start() + m.start(), run.start() + m.end()) for m in GROUP.finditer(run[0])] if run[0].count(".") > 3 else []
            found += [("ip", parts[i][1], parts[i + 3][2]) for i in range(len(parts) - 3) if all(_small(p) for p, _, _ in parts[i : i + 4])]
        found += [("ip", m.start(), m.end()) for m in BRACKET_DOTS.finditer(text) if all(map(_small, GROUP.findall(m[0])))]
    if ":" in text:
        found += [("ip", m.start(), m.end()) for m in SIXES.finditer(text) if m[0].count(":") > 1 and _is_six(m[0])]
    for run in DIGIT_RUN.finditer(text):
        if run.end() - run.start() < 16:
            continue
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in GROUP.finditer(run[0])]
        for i, (start, _) in enumerate(groups):
            count = 0
            for j in range(i, len(groups)):
                first, last = groups[j]
                count += last - first
                if count > 19:
                    break
                if 16 <= count <= 19 and luhn(_digits(text[start:last])):
                    found.append(("card", start, last))
    found += [("card", m.start(), m.end()) for p in (OTHER_CARD, SHORT_CARD) for m in p.finditer(text) if luhn(_digits(m[0]))]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PLUS_SHAPE.finditer(text)]
    return found + [("phone", m.start(), m.end()) for p in (NATIONAL, ABROAD, AREA) for m in p.finditer(text) if 9 <= len(_digits(m[0])) <= 17]


def _is_six(span: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(span)) and span.strip(":") != ""
    except ValueError:
        return False


def _gazetteer(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        top = LAST_LETTERS.search(span)[0].lower()
        return 4 if top in TOP_DOMAINS else 3 if top in COUNTRY_DOMAINS else 2 if len(top) == 2 else 1 if top else 0
    if kind == "card":
        lengths = [n for prefix, n in ISSUERS.items() if digits.startswith(prefix)]
        return 4 if any(len(digits) in n for n in lengths) else 2 if lengths else 0
    if kind == "phone":
        plain = digits.removeprefix("00") if span.startswith("00") else digits
        return (4 if plain.startswith(COUNTRY_CODES) else 0) if span.startswith(("+", "00")) else 2
    return 0 if span.startswith(("0.", "255.")) else 4 if span.startswith(("10.", "192.168.", "172.")) or ":" in span else 2


def _rule(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 0 if ".." in span or ".@" in span or "-." in span else 4
    if kind == "ip":
        return 4 if ":" in span or all(p == "0" or p[0] != "0" for p in GROUP.findall(span)) else 0
    if kind == "card":
        return 4 if luhn(digits) else 0
    return 4 if (8 if span.startswith("+") else 9) <= len(digits) <= 15 and span.count("(") == span.count(")") else 0


def _separators(kind: str, span: str) -> int:
    """Whether groups are set apart in one way (4 or 3), not at all (2), or in several (0, 1)."""
    if kind == "email":
        return 3 if span.count("@") == 1 else 4 if "(" in span or "[" in span else 1
    marks = set(MARKS.findall(span.removeprefix("+").replace("(", "").replace(")", "-")))
    groups = {len(g) for g in GROUP.findall(span)}
    if kind == "ip":
        return 3 if len(marks) == 1 else 1
    return (2 if kind == "phone" or len(span) < 20 else 1) if not marks else 4 if len(marks) == 1 and len(groups) <= 2 else 3 if len(marks) == 1 else 2 if kind == "phone" and len(marks) == 2 else 0


def _context(text: str, kind: str, start: int, end: int) -> int:
    before = [w.lower() for w in WORD_BEFORE.findall(text[max(0, start - CONTEXT) : start])]
    after = [w.lower() for w in WORD_BEFORE.findall(text[end : end + CONTEXT // 2])]
    near, all_ = set(before[-2:]), set(before + after)
    if near & FOR[kind]:
        return 4
    if near & AGAINST:
        return 0
    return 3 if all_ & FOR[kind] else 1 if all_ & AGAINST else 2


def _neighbours(text: str, start: int, end: int) -> int:
    before, after = text[start - 1 : start], text[end : end + 1]
    touching = before.isalnum() or before in tuple("@_/.=+-") or after.isalnum() or after in tuple("@_/=") or text[end : end + 2].rstrip() in tuple(".%d" % d for d in range(10))
    if touching and (before or after):
        return 0
    return 4 if before in tuple("(<[:\"'") and before else 3


def _filler(digits: str) -> int:
    if not digits:
        return 2
    steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:], strict=False)}
    return 0 if len(set(digits)) < 3 or len(steps) == 1 else 2


def pattern(text: str, kind: str, start: int, end: int) -> str:
    """The candidate's pattern: kind, graded votes and shape bits."""
    span = text[start:end]
    digits = _digits(span) if kind != "email" else ""
    votes = (
        4 if STRICT[kind].fullmatch(span) else 1,
        _rule(kind, span, digits),
        _gazetteer(kind, span, digits),
        _context(text, kind, start, end),
        _neighbours(text, start, end),
        _separators(kind, span),
        _filler(digits),
    )
    bits = (len(span) > 16, any(c in span for c in " -("), span.startswith("+"), kind == "email" and any(c.isdigit() for c in span))
    return f"{kind}|{''.join(map(str, votes))}|{''.join('01'[b] for b in bits)}"


def _stretches(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans take, in order."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda x: x[1]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _free(starts: list[int], ends: list[int], start: int, end: int) -> int | None:
    """The place among the stretches of one that overlaps none of them; None if it overlaps any."""
    place = bisect_left(starts, end)  # stretches before it begin before the new one ends
    return place if place == 0 or ends[place - 1] <= start else None


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, pattern) of all candidates: base spans, then proposals that overlap none."""
    if "@" not in text and not ANY_DIGIT.search(text) and not SPELLED_SIGN.search(text) and "::" not in text:
        return []
    base = base_spans(text)
    starts, ends = _stretches(base)
    more = [s for s in dict.fromkeys(proposed_spans(text)) if _free(starts, ends, s[1], s[2]) is not None]
    return [(*s, True, pattern(text, *s)) for s in base] + [(*s, False, pattern(text, *s)) for s in more]


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Each pattern's posterior under the label model, by expectation-maximisation over the counts.

    A labeler has, for either truth, its own distribution over its levels where it votes; that it does
    not says nothing. Each kind has its own prior. Pseudo-counts that favour a labeler that is right keep the truth from swapping sides.
    """
    if not counts:
        return {}
    names = sorted(counts)
    weight = np.array([counts[p] for p in names], float)
    kind = np.array([KINDS.index(p.split("|")[0]) for p in names])
    votes = np.array([[int(c) for c in p.split("|")[1]] for p in names])
    posterior = 1 / (1 + np.exp(-(votes - 2).sum(axis=1) / 2.0))
    hot = np.eye(LEVELS)[votes] * (votes != 2)[:, :, None]
    rising = np.linspace(1.0, 3.0, LEVELS)
    guess = np.stack([rising[::-1], rising])
    for _ in range(rounds):
        truth = np.stack([1 - posterior, posterior])
        prior = np.array([[(weight * t)[kind == k].sum() + 1 for k in range(len(KINDS))] for t in truth])
        prior /= prior.sum(axis=0)
        tables = np.einsum("tn,nlv->tlv", truth * weight, hot) + guess[:, None, :]
        tables /= tables.sum(axis=2, keepdims=True)
        logs = np.log(prior[:, kind]) + np.einsum("nlv,tlv->tn", hot, np.log(tables))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return dict(zip(names, posterior.tolist(), strict=True))


def _features(names: list[str]) -> np.ndarray:
    rows = []
    for name in names:
        kind, votes, bits = name.split("|")
        grades = [(int(v) - 2) / 2 for v in votes]
        one = [1.0] + [float(kind == k) for k in KINDS] + grades
        one += [float(v == s) for v in votes for s in "04"] + [float(b) for b in bits]
        one += [g * (kind == k) for k in KINDS for g in grades[:4]]
        rows.append(one)
    return np.array(rows)


def train(counts: dict[str, int], rounds: int = 30, ridge: float = 1.0) -> dict[str, float]:
    """The span classifier's probability for every pattern: ridge logistic regression by Newton steps."""
    if not counts:
        return {}
    target = estimate(counts)
    names = sorted(counts)
    x, y = _features(names), np.array([target[n] for n in names])
    weight = np.sqrt(np.array([counts[n] for n in names], float))  # frequent patterns shall not drown rare ones
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(curve, slope)
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist(), strict=True))


def decide(found: list[tuple[str, int, int, bool, str]], model: dict[str, float]) -> list[tuple[str, int, int]]:
    """Base spans and the accepted others, by kind as listed, then start."""
    kept = [(k, s, e) for k, s, e, base, _ in found if base]
    more = sorted((-model.get(p, 0.0), s, KINDS.index(k), e) for k, s, e, base, p in found if not base and model.get(p, 0.0) >= 0.5)
    starts, ends = _stretches(kept) if more else ([], [])
    for _, start, kind, end in more:
        if (place := _free(starts, ends, start, end)) is not None:
            starts.insert(place, start)
            ends.insert(place, end)
            kept.append((KINDS[kind], start, end))
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_CANDIDATES = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,pattern:string>>"
_FIELDS = ("kind", "start", "end", "base", "pattern")
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(_FIELDS, c, strict=True)) for c in candidates(x.as_py())] for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, _ARROW)], ["id", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): every row's candidates, staged."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return staged(rows.mapInArrow(_scan, rows.select("id", F.expr(f"cast(array() as {_CANDIDATES})").alias("found")).schema), "pii-candidates")


def learn(scanned: DataFrame) -> dict[str, float]:
    """The classifier from the counts of all patterns, of which there are at most 4 * 2 * 2 * 5^4 * 2 * 2^4."""
    counts = scanned.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().collect()
    return train({r["pattern"]: r["count"] for r in counts})


def spans(scanned: DataFrame, model: dict[str, float]) -> DataFrame:
    """(id, base, spans): arrays of kind, start, end of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def as_structs(found):
        return [{"kind": k, "start": s, "end": e} for k, s, e in found]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[tuple(c[f] for f in _FIELDS) for c in x.as_py()] for x in batch.column("found")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([as_structs(decide([c for c in r if c[3]], {})) for r in rows], kind), pa.array([as_structs(decide(r, model)) for r in rows], kind)],
                ["id", "base", "spans"],
            )

    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    return scanned.mapInArrow(settle, scanned.select("id", empty.alias("base"), empty.alias("spans")).schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null."""
    model = learn(scan(docs, id_col, text_col))

    def masked(text: str | None) -> str | None:
        if text is None or not (found := candidates(text)):
            return text
        out, at = [], 0
        for kind, start, end in sorted(decide(found, model), key=lambda x: (x[1], x[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            column = pa.array([masked(x.as_py()) for x in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents"))
    found = spans(scanned, learn(scanned))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def digest(found: list[tuple[str, int, int]]) -> str:
    """The digest of base spans as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
