"""Personal data by rules and a character-level bidirectional LSTM with CRF transitions (operator 7).

Rules find mail addresses, IP addresses, cards and phone numbers. A small tagger, trained in numpy from labelled spans, adds spans that the rules' forms
miss. Its training set is a bounded sample: for each kind, and for texts without any, the ``PER_KIND`` snippets with the least hashes over all documents, with the rules'
spans as labels (spans of over ``LONGEST`` characters aren't learnt from), and ``COPIES`` copies of each with the spans in other forms (``FORMS``) and other digits. Every span that
a kind's plain conditions accept holds a digit, an @,
or one of the words for it ("(at)", "[at]", " at ") between a local part and a domain with a dot, so windows are laid around those signs, over the whole address;
a text without them has no windows. Windows of ``WINDOW`` characters overlap by half. Each is decoded by Viterbi; then each
character takes the tag from the window in whose middle half it stands, so tags form one sequence over the text, from which spans are read. A span is added if the mean of
its tags' marginal probabilities (forward-backward over the CRF) is ``MIN_SCORE`` or more, it meets no rule's span, and its kind's plain conditions hold (digits, checksum, parts).

Edge cases: null and empty texts have no spans; a corpus without labelled spans trains nothing and adds none; texts of any length are searched whole, in linear time; repeated rows
get equal results; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm.common import shared_table

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SIGN = r"[0-9@]|(?<=[A-Za-z0-9._%+-])(?:\(at\)|\[at\]| at )(?=[A-Za-z0-9])"  # in Java's syntax as well
SIGNS = re.compile(SIGN)
AT = r"(?: ?@ ?|\(at\)|\[at\]| at )"
HOST = re.compile(AT + r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile("[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PER_KIND, COPIES, LONGEST = 128, 3, 200
WINDOW, EMBED, HIDDEN, STEPS, BATCH, MIN_SCORE = 64, 12, 24, 250, 48, 0.6
#: What stands between the parts of a span in other forms, by kind; phones have other beginnings.
FORMS = [(" @ ", "(at)", " at ", "[at]"), ("[.]", " . ", "-"), (".", "/", "  "), ("", "0", "00", "(0)")]
FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
Span = tuple[int, int, int]  # start, kind, end


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def plausible(kind: int, text: str) -> bool:
    """What every span of the kind meets, of the rules or not."""
    n = digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+" + AT + r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text))
    if kind == 1:
        parts = re.fullmatch(r"([0-9]+)(\.|\[\.\]| \. |-)([0-9]+)\2([0-9]+)\2([0-9]+)", text)
        return bool(parts) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts.group(1, 3, 4, 5))
    return 12 <= len(n) <= 19 and luhn(n) if kind == 2 else 9 <= len(n) <= 15


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, @, domain with a dot; leftmost, without overlap, each character looked at once or twice."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            past = m.end()
        else:
            past = at + 1
        at = text.find("@", past)


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind."""
    out = [(a, 0, b) for a, b in mails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if plausible(kind, m[0])]
    return sorted(out)


def codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"), 127).astype(np.int64)


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int64)
    for a, kind, b in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


class Tagger:
    """Embedding, an LSTM in each direction, and a CRF over the tags. Both directions are worked on together; the second reads the window from its end."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *shape: r.normal(0, 1 / np.sqrt(shape[-2]), shape)
        self.p = {"E": r.normal(0, 0.5, (128, EMBED)), "O": init(2 * HIDDEN, TAGS), "o": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        self.p |= {"X": init(2, EMBED, 4 * HIDDEN), "H": init(2, HIDDEN, 4 * HIDDEN), "c": np.tile(np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)], (2, 1))}

    def lstm(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: direction, time, batch, embedding. Gates are in, forget and out by logistic, the candidate by tanh: one tanh does for all."""
        n = x.shape[:3]
        pre, out = x @ self.p["X"][:, None] + self.p["c"][:, None, None], np.zeros((2, n[1] + 1, n[2], HIDDEN), x.dtype)
        cells, gates, tanhs = np.zeros_like(out), np.empty_like(pre), np.empty((*n, HIDDEN), x.dtype)
        half = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(x.dtype)
        for t in range(n[1]):
            z = np.tanh((pre[:, t] + out[:, t] @ self.p["H"]) * half)
            z[..., : 3 * HIDDEN] = (z[..., : 3 * HIDDEN] + 1) / 2
            i, f, o, g = (z[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            gates[:, t] = z
            cells[:, t + 1] = f * cells[:, t] + i * g
            tanhs[:, t] = np.tanh(cells[:, t + 1])
            out[:, t + 1] = o * tanhs[:, t]
        return out[:, 1:], (out[:, :-1], cells, gates, tanhs)

    def lstm_back(self, x: np.ndarray, kept: tuple, dout: np.ndarray, grad: dict) -> np.ndarray:
        before, cells, gates, tanhs = kept
        dz, back = np.empty_like(gates), self.p["H"].transpose(0, 2, 1)
        dh = dc = np.zeros_like(dout[:, 0])
        for t in reversed(range(x.shape[1])):
            i, f, o, g = (gates[:, t, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            tc, d = tanhs[:, t], dz[:, t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            d[..., :HIDDEN] = dc * g * i * (1 - i)
            d[..., HIDDEN : 2 * HIDDEN] = dc * cells[:, t] * f * (1 - f)
            d[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            d[..., 3 * HIDDEN :] = dc * i * (1 - g * g)
            dc, dh = dc * f, d @ back
        rows = lambda a: np.ascontiguousarray(a).reshape(2, -1, a.shape[-1])
        grad["H"] += rows(before).transpose(0, 2, 1) @ rows(dz)
        grad["X"] += rows(x).transpose(0, 2, 1) @ rows(dz)
        grad["c"] += dz.sum((1, 2))
        return dz @ self.p["X"].transpose(0, 2, 1)[:, None]

    def emit(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (time, batch, tag) of windows (batch, time)."""
        x = self.p["E"][ids.T]
        both = np.stack([x, x[::-1]])
        out, kept = self.lstm(both)
        h = np.concatenate([out[0], out[1, ::-1]], axis=2)
        return h @ self.p["O"] + self.p["o"], (both, kept, h)

    def marginals(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over the CRF, each place scaled to a sum of 1: the probabilities of tags (time, batch, tag), and those of pairs of neighbours, summed over places and windows."""
        e, trans = np.exp(u - u.max(2, keepdims=True)), np.exp(self.p["T"] - self.p["T"].max())
        alpha, beta, scale = np.empty_like(u), np.ones_like(u), np.empty((*u.shape[:2], 1), u.dtype)
        for t in range(len(u)):
            a = (alpha[t - 1] @ trans if t else 1.0) * e[t]
            scale[t] = a.sum(1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in reversed(range(len(u) - 1)):
            beta[t] = (e[t + 1] * beta[t + 1] / scale[t + 1]) @ trans.T
        pairs = alpha[:-1].reshape(-1, TAGS).T @ (e[1:] * beta[1:] / scale[1:]).reshape(-1, TAGS) * trans
        return alpha * beta, pairs

    def step(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean negative log-likelihood."""
        u, (x, kept, h) = self.emit(ids)
        tags, n = tags.T, len(ids)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        du, grad["T"] = self.marginals(u)
        np.add.at(grad["T"], (tags[:-1], tags[1:]), -1)
        np.put_along_axis(du, tags[:, :, None], np.take_along_axis(du, tags[:, :, None], 2) - 1, 2)
        grad["O"], grad["o"] = h.reshape(-1, 2 * HIDDEN).T @ du.reshape(-1, TAGS), du.sum((0, 1))
        dh = du @ self.p["O"].T
        dx = self.lstm_back(x, kept, np.stack([dh[..., :HIDDEN], dh[::-1, :, HIDDEN:]]), grad)
        np.add.at(grad["E"], ids.T, dx[0] + dx[1, ::-1])
        return {k: v / n for k, v in grad.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 7) -> Tagger:
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        r, m, v = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for s in range(1, steps + 1):
            some = r.integers(0, len(ids), BATCH)
            grad = self.step(ids[some], tags[some])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / norm)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= 0.02 * min(1.0, 1.5 - 1.4 * s / steps) * m[k] / (1 - 0.9**s) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        return self

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags and their marginal probabilities by character, both (batch, time)."""
        u, _ = self.emit(ids)
        best, back = u[0], np.empty(u.shape, dtype=np.int64)
        for t in range(1, len(u)):
            s = best[:, :, None] + self.p["T"]
            back[t] = s.argmax(1)
            best = u[t] + s.max(1)
        tags = np.empty(u.shape[:2], dtype=np.int64)
        tags[-1] = best.argmax(1)
        for t in reversed(range(1, len(u))):
            tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None], 1)[:, 0]
        return tags.T, np.take_along_axis(self.marginals(u)[0], tags[:, :, None], 2)[:, :, 0].T


def places(text: str) -> Iterator[tuple[int, int]]:
    """Each sign, from the local part before it to the end of the domain after it if it stands in a mail address; each character is walked over once or twice."""
    past = 0
    for m in SIGNS.finditer(text):
        start = end = m.start()
        if not text[start].isdigit():
            host = HOST.match(text, start - 1) if start and text[start - 1] == " " and text[start] == "@" else HOST.match(text, start)
            if host:
                start, end = host.start(), host.end() - 1
                while start > past and LOCAL.match(text[start - 1]):
                    start -= 1
                past = end
            elif text[start] != "@":
                continue  # " at " in prose
        yield start, end


def window_starts(text: str) -> list[tuple[int, bool, bool]]:
    """Starts of windows around the signs, and whether a window is the first or last of its zone."""
    zones: list[list[int]] = []
    for a, b in places(text):
        if zones and a - 24 <= zones[-1][1]:
            zones[-1][1] = max(zones[-1][1], b + 24)
        else:
            zones.append([max(0, a - 24), b + 24])
    out = []
    for a, b in zones:
        starts = [*range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2)]
        out += [(s, s == starts[0], s == starts[-1]) for s in starts]
    return out


def windows_of(ids: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.r_[ids, np.zeros(WINDOW, dtype=np.int64)]
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)]


def added_spans(tagger: Tagger | None, texts: list[str], base: list[list[Span]], batch: int = 512) -> list[list[Span]]:
    """The tagger's spans beside the rules', by text."""
    out: list[list[Span]] = [[] for _ in texts]
    jobs = [(t, *w) for t, text in enumerate(texts) for w in window_starts(text)] if tagger else []
    ids = {t: codes(texts[t]) for t in {j[0] for j in jobs}}
    found: dict[int, list[tuple[int, int, float]]] = {}
    for k in range(0, len(jobs), batch):
        part = jobs[k : k + batch]
        tags, sure = tagger.decode(np.concatenate([windows_of(ids[t], [s]) for t, s, _, _ in part]))
        for (t, s, first, last), row, p in zip(part, tags, sure):
            a, b = 0 if first else WINDOW // 4, WINDOW if last else 3 * WINDOW // 4
            found.setdefault(t, []).extend((s + i, int(row[i]), float(p[i])) for i in range(a, min(b, len(texts[t]) - s)) if row[i])
    for t, marks in found.items():
        runs: list[list] = []  # start, kind, end, probabilities
        for at, tag, p in sorted(marks):
            kind = (tag - 1) // 2
            if runs and tag % 2 == 0 and runs[-1][2] == at and runs[-1][1] == kind:
                runs[-1][2] = at + 1
                runs[-1][3].append(p)
            elif not runs or at >= runs[-1][2]:
                runs.append([at, kind, at + 1, [p]])
        for a, kind, b, p in runs:
            text = texts[t][a:b]
            a, b = a + len(text) - len(text.lstrip(" .,;:")), b - len(text) + len(text.rstrip(" .,;:"))
            if a < b and np.mean(p) >= MIN_SCORE and plausible(kind, texts[t][a:b]) and not any(x < b and a < y for x, _, y in base[t]):
                out[t].append((a, kind, b))
    return out


def in_form(kind: int, span: str, form: str) -> str:
    """A span of the rules in another form."""
    if kind == 0:
        return span.replace("@", form)
    if kind == 1:
        return span.replace(".", form)
    if kind == 2:
        return re.sub(".{4}(?=.)", lambda m: m[0] + form, digits(span))
    return form + re.sub(r"^\+[0-9]{1,3}[ -]?(?=[(0-9])", "", span).lstrip("0" if form else "")


def rewritten(text: str, spans: list[Span], way: int) -> tuple[str, list[Span]]:
    """A copy with the spans in forms that the rules miss."""
    out, moved, at = "", [], 0
    for a, kind, b in spans:
        if a < at:
            continue
        new = in_form(kind, text[a:b], FORMS[kind][way % len(FORMS[kind])])
        out += text[at:a]
        moved.append((len(out), kind, len(out) + len(new)))
        out, at = out + new, b
    return out + text[at:], moved


def other_digits(text: str, spans: list[Span], seed: np.random.Generator) -> str:
    """The text with random digits in the spans; an IP address keeps parts of up to 255."""
    for a, kind, b in spans:
        if kind == 1:
            new = re.sub("[0-9]+", lambda m: str(seed.integers(10 ** (len(m[0]) - 1) if len(m[0]) > 1 else 0, min(256, 10 ** min(3, len(m[0]))))).rjust(len(m[0]), "0"), text[a:b])
        else:
            new = re.sub("[0-9]", lambda m: str(seed.integers(10)), text[a:b])
        text = text[:a] + new + text[b:]
    return text


def labelled(docs: DataFrame, per_kind: int = PER_KIND) -> list[tuple[str, list[Span]]]:
    """Snippets with their rules' spans: of each kind, and of texts without, at most so many, those with the least hashes of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                around = spans or [(m.start(), -1, m.end()) for m in [SIGNS.search(text)] if m]
                out += [(k, text[max(0, a - 40) : b + 40]) for a, k, b in around if b - a <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([t for _, t in out], pa.string())], names=["kind", "snippet"])

    found = shared_table(docs.select("text").filter(F.col("text").rlike(SIGN)).mapInArrow(run, "kind int, snippet string").distinct().withColumn("h", F.xxhash64("snippet")))
    left, rows = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}, []  # a row a kind
    wide = 4
    while left:  # hashes are even, so those below a share of their range are about that share of the rows; a kind that has too few there is asked again
        least = {k: int(-(2**63) + min(1.0, wide * per_kind / n) * (2**64 - 1)) for k, n in left.items()}
        few = found.filter(reduce(lambda x, y: x | y, ((F.col("kind") == k) & (F.col("h") <= min(h, 2**63 - 1)) for k, h in least.items())))
        nth = F.row_number().over(Window.partitionBy("kind").orderBy("h", "snippet"))  # over a few times per_kind rows of each kind
        got = few.withColumn("nth", nth).filter(F.col("nth") <= per_kind).orderBy("kind", "nth").collect()
        enough = {k for k, n in left.items() if sum(r.kind == k for r in got) >= min(per_kind, n)}
        rows += [r for r in got if r.kind in enough]
        left, wide = {k: n for k, n in left.items() if k not in enough}, 4 * wide
    return [(r.snippet, base_spans(r.snippet)) for r in rows]


def train(docs: DataFrame) -> Tagger | None:
    """The tagger of a corpus; None if it has no labelled spans."""
    known, seed = labelled(docs), np.random.default_rng(11)
    if not any(s for _, s in known):
        return None
    for i, (text, spans) in enumerate([k for k in known if k[1]]):
        for way in range(COPIES):
            plain = other_digits(text, spans, seed)
            known.append(rewritten(plain, spans, i + way))
    ids, tags = [], []
    for text, spans in known:
        starts = [s for s, _, _ in window_starts(text)]
        if starts:
            ids.append(windows_of(codes(text), starts))
            tags.append(windows_of(tags_of(len(text), spans), starts))
    return Tagger().fit(np.concatenate(ids), np.concatenate(tags))


def find_personal(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the rules'), base_sha256, spans (all, kind:start:end) of every document. A tagger trained before serves as it is; without one, docs train it."""
    tagger = docs.sparkSession.sparkContext.broadcast(tagger or train(docs))

    def listed(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        plain = [t or "" for t in texts.to_pylist()]
        base = [base_spans(t) if t else [] for t in plain]
        more = added_spans(tagger.value, plain, base)
        rows = []
        for own, extra in zip(base, more):
            counts = {k: len([*g]) for k, g in groupby(sorted(k for _, k, _ in own))}
            rows.append((*(counts.get(k, 0) for k in range(len(KINDS))), hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + extra)))
        types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], FOUND.names)

    signed = F.when(F.col("text").rlike(SIGN), F.col("text"))  # texts without signs stay in the JVM
    return docs.select("doc_id", run(signed).alias("f")).select("doc_id", "f.*")
