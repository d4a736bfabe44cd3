"""Secret scans: fixed patterns, and a small character convolutional network over other candidates.

The base kinds are assign, access and hex. Every other token of 6 or more key characters is a candidate: words, numbers,
ids and e-mails too. The network reads the candidate with its surrounding characters, which move its logit by at most
`lean` either way; so a token that stays under the threshold by more than that is settled without them, once for all its
places. It is trained with numpy on labelled findings: by default those of the corpus itself, where the value of a base
finding is a positive one, and a candidate that overlaps none is negative. Every different finding trains or calibrates it:
positive ones and candidates with digits with each of their surroundings (half of their tokens without), candidates without
digits once each, as they stand in the corpus by the hundred million, and without surroundings; all of them in either case.

Findings are dealt into slots, by as many as there are, and each of `epochs` rounds trains one copy of the network in every
slot and averages the copies; a slot reads its findings in all rounds where they are few, else a part of them in each, so
that none is left out. The groups of findings (positive; negative ones of letters, digits or both) weigh as 3, 1, 1 and 1.
A held-out third calibrates the scores (Platt) and sets the threshold, from counts of its logits in steps of 1 / `steps`: the highest step that keeps
`recall` of the held-out positives, whatever the precision beside it (`Detector.precision`); secrets that the base patterns miss count
as negative there. A candidate longer than `body` is read in overlapping windows, each with its surroundings, and its
highest score counts. A candidate at or above it becomes a span of kind 'net'.

Defined cases: a null text counts as an empty one and has no spans; an empty table gives no rows. Without positive or
without negative findings there is no network, and base spans stand alone. Added spans never overlap base ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, id_text

KINDS = ("assign", "access", "hex")

#: The patterns of the base kinds and the keywords that any assignment holds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@-]{6,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-:\"' \n"


@dataclass(frozen=True)
class Net:
    context: int = 24
    body: int = 48
    embed: int = 8
    width: int = 5
    filters: int = 24
    epochs: int = 12
    rate: float = 0.02
    #: Findings of a group that a slot holds, that it reads in a round, and that it has at least by repeating those of small groups.
    slot: int = 49_152
    turn: int = 4_096
    least: int = 64
    recall: float = 0.98
    #: Steps of a logit that the held-out findings are counted by.
    steps: int = 1024
    seed: int = 7
    #: Most that the context may add to or take from the logit.
    lean: float = 4.0
    #: Tokens whose logits a task keeps at a time.
    cached: int = 200_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start and then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of tokens of 6 or more key characters."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def shape(token: str) -> int:
    """0: without digits, 1: without letters, 2: both."""
    return 0 if not DIGIT.search(token) else 2 if LETTER.search(token) else 1


def order_key(token: str) -> bytes:
    return hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest()


_CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_OTHER = len(ALPHABET) + 1
_FLIPPED = np.array([0, *(_CODE[c.swapcase()] for c in ALPHABET), _OTHER], dtype=np.int8)
_BYTES = np.array([0, *(_CODE.get(chr(i), _OTHER) for i in range(1, 128))], dtype=np.int8)
_TRANSLATED = bytes([*_BYTES.tolist(), *[_OTHER] * 128])


def windows(start: int, end: int, net: Net) -> list[tuple[int, int]]:
    """A span as it is, or where it is longer than net.body as windows of that length, half a window apart, the last one at its end."""
    if end - start <= net.body:
        return [(start, end)]
    starts = [*range(start, end - net.body, net.body // 2), end - net.body]
    return [(s, s + net.body) for s in starts]


def encoded(text: str, start: int, end: int, net: Net, masked: bool = False) -> np.ndarray:
    """Codes of the context before, the candidate and the context after, each cut or padded to its own length; masked: without the contexts."""
    parts = (text[max(0, start - net.context) : start].rjust(net.context, "\0"), text[start:end][: net.body].ljust(net.body, "\0"), text[end : end + net.context].ljust(net.context, "\0"))
    out = np.array([0 if c == "\0" else _CODE.get(c, _OTHER) for c in "".join(parts)], dtype=np.int8)
    if masked:
        out[: net.context] = 0
        out[net.context + net.body :] = 0
    return out


def bare(token: str, net: Net) -> bytes:
    """Codes of a candidate of ASCII characters alone."""
    return token[: net.body].encode("ascii").translate(_TRANSLATED)


def padded(codes: list[bytes], net: Net) -> np.ndarray:
    """Rows of bare candidates, no wider than they need; places behind the end all see padding alone, and one of them stands for all."""
    wide = min(net.body, max(map(len, codes)) + net.width)
    return np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in codes), dtype=np.int8).reshape(len(codes), wide)


def unpacked(codes: list[bytes], net: Net) -> np.ndarray:
    """Rows of candidates with their contexts, which are padding where the codes are of a bare candidate."""
    whole = 2 * net.context + net.body
    rows = (c if len(c) == whole else (b"\0" * net.context + c).ljust(whole, b"\0") for c in codes)
    return np.frombuffer(b"".join(rows), dtype=np.int8).reshape(len(codes), whole)


def other_case(x: np.ndarray, net: Net) -> np.ndarray:
    """Rows with their candidates in the other case."""
    if x.shape[1] <= net.body:
        return _FLIPPED[x]
    out, body = x.copy(), slice(net.context, net.context + net.body)
    out[:, body] = _FLIPPED[out[:, body]]
    return out


class CharNet:
    """Embedding, one convolution with ReLU, maximum over the places of the candidate and over those of its context, a dense layer for
    either, that of the context bounded by tanh; Adam on the log loss."""

    def __init__(self, net: Net) -> None:
        g = np.random.default_rng(net.seed)
        self.net = net
        self.w = {
            "e": g.normal(0, 0.5, (_OTHER + 1, net.embed)),
            "c": g.normal(0, (net.width * net.embed) ** -0.5, (net.width * net.embed, net.filters)),
            "b": np.zeros(net.filters),
            "d": g.normal(0, net.filters**-0.5, net.filters),
            "o": np.zeros(1),
            "q": np.zeros(net.filters),
        }

    def places(self, x: np.ndarray) -> np.ndarray:
        emb = self.w["e"][x]
        return np.lib.stride_tricks.sliding_window_view(emb, self.net.width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - self.net.width + 1, -1)

    def pooled(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        act = places @ self.w["c"] + self.w["b"]
        best = act.argmax(axis=1)
        return best, np.maximum(0, np.take_along_axis(act, best[:, None, :], axis=1)[:, 0])

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate, and the contexts before and after it with a gap of padding between them; bare candidates share one empty context."""
        k = self.net.context
        if x.shape[1] <= self.net.body:
            return x, np.zeros((1, 2 * k + self.net.width), x.dtype)
        return x[:, k : k + self.net.body], np.concatenate([x[:, :k], np.zeros((len(x), self.net.width), x.dtype), x[:, k + self.net.body :]], axis=1)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple], np.ndarray]:
        seen = []
        for part in self.parts(x):
            seen.append((part, *self.pooled(self.places(part))))
        turn = np.tanh(seen[1][2] @ self.w["q"])
        return seen[0][2] @ self.w["d"] + self.w["o"][0] + self.net.lean * turn, seen, turn

    def body_logits(self, tokens: list[str]) -> np.ndarray:
        """What the candidates alone, of at most net.body ASCII characters, add to their logits."""
        out = np.zeros(len(tokens))
        by_length = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        for i in range(0, len(by_length), 512):
            rows = by_length[i : i + 512]
            out[rows] = self.pooled(self.places(padded([bare(tokens[j], self.net) for j in rows], self.net)))[1] @ self.w["d"] + self.w["o"][0]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss, summed by weight."""
        logit, seen, turn = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        bent = d * self.net.lean * (1 - turn * turn)
        if len(turn) < len(d):  # one context for all
            bent = bent.sum(keepdims=True)
        grads = {"d": seen[0][2].T @ d, "o": np.array([d.sum()]), "q": seen[1][2].T @ bent}
        grads |= {k: np.zeros_like(self.w[k]) for k in "ecb"}
        kinds, filters, width = _OTHER + 1, self.net.filters, self.net.width
        by_place = self.w["c"].reshape(width, self.net.embed, filters)
        for (part, best, top), dense, pull in zip(seen, "dq", (d, bent), strict=True):
            up = (pull[:, None] * self.w[dense]) * (top > 0)
            grads["b"] += up.sum(axis=0)
            # what each filter pulls at each code in each of its places: both other gradients are products with it
            codes = part[np.arange(len(part))[:, None, None], best[:, :, None] + np.arange(width)]
            at = (np.arange(filters)[:, None] * width + np.arange(width)) * kinds + codes
            pulled = np.bincount(at.ravel(), np.repeat(up.ravel(), width), filters * width * kinds).reshape(filters, width, kinds)
            grads["c"] += np.tensordot(pulled, self.w["e"], 1).transpose(1, 2, 0).reshape(-1, filters)
            grads["e"] += np.tensordot(pulled, by_place, ((0, 1), (2, 0)))
        return grads

    def descend(self, batches: Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]], rate: float) -> CharNet:
        """A step of Adam for each batch: parts of rows, labels and weights."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step, parts in enumerate(batches, 1):
            grads = [self.gradients(*part) for part in parts]
            for key in self.w:
                gr = sum(g[key] for g in grads)
                m[key] += 0.1 * (gr - m[key])
                v[key] += 0.001 * (gr * gr - v[key])
                self.w[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> CharNet:
        g = np.random.default_rng(self.net.seed)
        orders = (g.permutation(len(x)) for _ in range(self.net.epochs))
        rows = (order[at : at + 64] for order in orders for at in range(0, len(x), 64))
        return self.descend(([(x[r], y[r], np.full(len(r), 1 / len(r)))] for r in rows), self.net.rate)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.w.values()])

    def filled(self, values: np.ndarray) -> CharNet:
        ends = np.cumsum([v.size for v in self.w.values()])
        self.w = {k: part.reshape(v.shape) for (k, v), part in zip(self.w.items(), np.split(values, ends[:-1]), strict=True)}
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)


@dataclass
class Detector:
    net: CharNet
    slope: float
    offset: float
    threshold: float
    #: Of the held-out findings at or above the threshold, the share that is positive.
    precision: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.net.logits(x) + self.offset, -700, 700)))

    @property
    def least(self) -> float:
        """A candidate whose own logit is under this one stays under the threshold in any context."""
        if self.slope <= 0:
            return -np.inf
        t = min(max(self.threshold, 1e-300), 1 - 1e-15)
        return (np.log(t) - np.log1p(-t) - self.offset) / self.slope - self.net.net.lean - 1e-6


def platt(logit: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset by damped Newton steps on the log loss with Platt's targets, which stay finite where the labels are parted; n: how often a row counts."""
    n1, n0 = (n * (y == 1)).sum(), (n * (y == 0)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: (n * (np.logaddexp(0, a * logit + b) - target * (a * logit + b))).sum() + 5e-3 * ((a - 1) ** 2 + b * b)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-6)
        g = np.array([(n * (p - target) * logit).sum() + 1e-2 * (a - 1), (n * (p - target)).sum() + 1e-2 * b])
        h = np.array([[(w * logit * logit).sum() + 1e-2, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        while loss(a - step[0], b - step[1]) > loss(a, b) and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit_detector(x: np.ndarray, y: np.ndarray, net: Net = Net()) -> Detector | None:
    """Trains on two thirds, calibrates on one. None without both labels on either side."""
    held = np.arange(len(x)) % 3 == 2
    if any(len(np.unique(part)) < 2 for part in (y[held], y[~held])):
        return None
    # a key is a key and a word a word in the other case too
    model = CharNet(net).fit(np.concatenate([x[~held], other_case(x[~held], net)]), np.concatenate([y[~held], y[~held]]))
    a, b = platt(logit := model.logits(x[held]), y[held])
    p = 1 / (1 + np.exp(-(a * logit + b)))
    positive = np.sort(p[y[held] == 1])
    at = float(positive[int((1 - net.recall) * len(positive))])
    return Detector(model, a, b, at, float(y[held][p >= at].mean()))


FINDINGS = "order long, codes binary, label int, shape int"
#: Words, other negative findings of each shape and positive ones that a step reads, and what each group weighs.
BATCH, SHARE = (256, 16, 16, 32), (1 / 6, 1 / 6, 1 / 6, 1 / 2)
#: Weights of the network are averaged as whole numbers of this part, so that the order of adding doesn't matter.
UNIT = 2.0**-32


def findings(docs: DataFrame, net: Net = Net()) -> DataFrame:
    """Labelled findings of the corpus: order (a hash of the token), codes (of the bare candidate where the surroundings aren't read), label and shape; each at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: Negative tokens that are read without their surroundings, so that once is enough.
        told: set[str] = set()
        for b in batches:
            rows: list[tuple[int, bytes, int, int]] = []

            def note(text: str, s: int, e: int, label: int, kind: int, rows: list = rows) -> None:
                order = int.from_bytes(order_key(text[s:e]), "big", signed=True)
                alone = order % 2 == 1 or (label == 0 and kind == 0)
                rows.append((order, bare(text[s:e], net) if alone else encoded(text, s, e, net).tobytes(), label, kind))
                if alone and label == 0:
                    told.add(text[s:e])

            for text in b.column(1).to_pylist():
                base = base_spans(text)
                for kind, s, e in base:
                    if kind == "assign":  # the value alone, as a candidate is cut
                        s, e = ASSIGN.match(text, s).span(2)
                    note(text, s, e, 1, shape(text[s:e]))
                if len(told) > net.cached:
                    told.clear()
                tokens = {t: shape(t) for t in set(CANDIDATE.findall(text)) - told}
                if not base and not any(tokens.values()):  # words alone
                    for t in tokens:
                        note(t, 0, len(t), 0, 0)
                elif tokens:
                    for s, e in candidates(text):
                        if (t := text[s:e]) in tokens and t not in told and not any(s < y and x < e for _, x, y in base):
                            note(text, s, e, 0, tokens[t])
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["order", "codes", "label", "shape"])

    return id_text(docs).mapInArrow(run, FINDINGS)


def dealt(training: DataFrame, sizes: dict[int, int], net: Net) -> tuple[DataFrame, int]:
    """slot, g (the group), part of parts, and codes in the order of their tokens' hashes; and the number of slots."""
    slots = max(1, -(-max(sizes.values()) // net.slot))
    plan = {g: (copies := max(1, min(slots, -(-net.least * slots // n))), max(1, min(net.epochs, -(-n * copies // (slots * net.turn))))) for g, n in sizes.items()}
    told = lambda i: F.element_at(F.create_map(*[x for g, p in plan.items() for x in (F.lit(g), F.lit(p[i]))]), F.col("g"))
    rows = training.select("*", told(1).alias("parts"), F.explode(F.sequence(F.lit(0), told(0) - 1)).alias("copy"))
    rows = rows.select("order", "codes", "g", "parts", F.pmod(F.xxhash64("order") + F.col("copy"), F.lit(slots)).alias("slot"), F.pmod(F.xxhash64("order", F.lit("part")), F.col("parts")).alias("part"))
    inside = F.sort_array(F.collect_list(F.struct("order", "codes")))  # net.turn findings or so
    return rows.groupBy("slot", "g", "part", "parts").agg(F.transform(inside, lambda x: x["codes"]).alias("codes")), slots


def slot_round(net: Net, k: int, start: np.ndarray):  # noqa: ANN201
    """What a slot does in round k: goes on from the weights by itself; a row a weight, or none without findings of both labels."""
    rate = net.rate * (1 - k / net.epochs)

    def batches(groups: dict[int, list[bytes]]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        negative = sum(SHARE[g] for g in groups if g < 3)
        # each finding of the round is read, those of small groups more often
        for i in range(max(16, *(-(-len(codes) // BATCH[g]) for g, codes in groups.items()))):
            parts = []
            for g, codes in groups.items():
                size = min(BATCH[g], len(codes))
                chosen = sorted((codes[j % len(codes)] for j in range(i * size, (i + 1) * size)), key=len)
                x = padded(chosen, net) if g == 0 and len(chosen[-1]) <= net.body else unpacked(chosen, net)
                # a key is a key and a word a word in the other case too
                turned = np.arange(size) % 2 == (i + k) % 2
                share = SHARE[g] if g == 3 else SHARE[g] / negative / 2
                parts.append((np.where(turned[:, None], other_case(x, net), x), np.full(size, float(g == 3)), np.full(size, share / size)))
            yield parts

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {int(g): [c for codes in of["codes"] for c in codes] for g, of in pdf.groupby("g")}
        if 3 not in groups or len(groups) < 2:
            return pd.DataFrame({"at": np.zeros(0, np.int32), "v": np.zeros(0, np.int64)})
        own = CharNet(net).filled(start).descend(batches(groups), rate).flat()
        return pd.DataFrame({"at": np.arange(len(own), dtype=np.int32), "v": np.rint(own / UNIT).astype(np.int64)})

    return run


def averaged(packed: DataFrame, slots: int, net: Net) -> CharNet:
    """The network after net.epochs rounds: in each, every slot goes on from the last average."""
    model = CharNet(net)
    for k in range(net.epochs):
        now = packed.where(F.pmod(F.lit(k), F.col("parts")) == F.col("part")).select("slot", "g", "codes").repartition(slots, "slot")
        values = model.flat()
        for r in now.groupBy("slot").applyInPandas(slot_round(net, k, values), "at int, v long").groupBy("at").agg(F.sum("v").alias("v"), F.count("*").alias("n")).collect():  # a row a weight
            values[r["at"]] = r.v / r.n * UNIT
        model.filled(values)
    return model


def held_logits(held: DataFrame, model: CharNet) -> DataFrame:
    """label, step and n: how many held-out findings have a logit in that step, of 1 / net.steps."""
    net = model.net

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(1).to_pylist()
            logit = np.zeros(len(codes))
            alone = sorted((i for i, c in enumerate(codes) if len(c) <= net.body), key=lambda i: len(codes[i]))
            full = [i for i, c in enumerate(codes) if len(c) > net.body]
            for of, made in ((alone, padded), (full, unpacked)):
                for i in range(0, len(of), 512):
                    logit[of[i : i + 512]] = model.forward(made([codes[j] for j in of[i : i + 512]], net))[0]
            step = np.floor(np.clip(logit, -64, 64) * net.steps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(step)], names=["label", "step"])

    return held.select("label", "codes").mapInArrow(run, "label int, step int").groupBy("label", "step").agg(F.count("*").alias("n"))


def trained(labelled: DataFrame, net: Net = Net()) -> Detector | None:
    """A detector from all different findings; a third of their tokens, by order, calibrates. None without both labels on either side."""
    kind = F.col("shape") if "shape" in labelled.columns else F.lit(0)
    scratch = Scratch(labelled.sparkSession)
    every = scratch.keep(labelled.select("order", "codes", "label", F.when(F.col("label") == 1, 3).otherwise(kind).alias("g")).distinct())
    every = every.withColumn("held", F.pmod("order", F.lit(3)) == 2)
    sizes = {(r.held, r.g): r["count"] for r in every.groupBy("held", "g").count().collect()}  # 8 rows at most
    if any({g == 3 for h, g in sizes if h == side} != {True, False} for side in (True, False)):
        scratch.close()
        return None
    packed, slots = dealt(every.where("not held"), {g: n for (h, g), n in sizes.items() if not h}, net)
    model = averaged(scratch.keep(packed), slots, net)
    counted = sorted((r.step, r.label, r.n) for r in held_logits(every.where("held"), model).collect())  # 256 * net.steps at most
    scratch.close()
    step, y, n = (np.array(c, dtype=float) for c in zip(*counted, strict=True))
    logit = step / net.steps
    a, b = platt(logit, y, n)
    p = 1 / (1 + np.exp(-np.clip(a * logit + b, -700, 700)))
    up = np.argsort(p, kind="stable")
    below = np.cumsum(n[up] * y[up])
    at = float(p[up][np.searchsorted(below, int((1 - net.recall) * below[-1]), side="right")])
    return Detector(model, a, b, at, float((n * y)[p >= at].sum() / n[p >= at].sum()))


def corpus_detector(docs: DataFrame, net: Net = Net()) -> Detector | None:
    """A detector from the findings of the corpus itself, which is read once for them."""
    return trained(findings(docs, net), net)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, net: Net = Net(), labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net and n_candidates for each row of docs."""
    detector = corpus_detector(docs, net) if labelled is None else trained(labelled, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, float] = {}
        least = detector.least if detector else 0.0
        for b in batches:
            texts = b.column(1).to_pylist()
            bases = [base_spans(t) for t in texts]
            tokens = [CANDIDATE.findall(t) for t in texts]
            where: list[tuple[int, int, int]] = []
            if detector:
                every_token = set().union(*tokens)
                if len(own) + len(every_token) > net.cached:
                    own.clear()
                fresh = [t for t in every_token if t not in own]
                cut = [(t, t[s:e]) for t in fresh for s, e in windows(0, len(t), net)]
                own.update(dict.fromkeys(fresh, -np.inf))
                for (t, _), logit in zip(cut, detector.net.body_logits([w for _, w in cut]), strict=True):
                    own[t] = max(own[t], logit)
                near = {t for t in every_token if own[t] >= least}
                for i, found in enumerate(tokens):
                    if not near.isdisjoint(found):
                        where += [(i, s, e) for s, e in candidates(texts[i]) if texts[i][s:e] in near and not any(s < y and x < e for _, x, y in bases[i])]
            extra: dict[int, list[tuple[str, int, int]]] = {}
            views = [(*at, *w) for at in where for w in windows(*at[1:], net)]
            told: set[tuple[int, int, int]] = set()
            for at in range(0, len(views), 4096):
                part = views[at : at + 4096]
                p = detector.scores(np.stack([encoded(texts[i], s, e, net) for i, _, _, s, e in part]))
                told.update(v[:3] for v, q in zip(part, p, strict=True) if q >= detector.threshold)
            for i, s, e in sorted(told):
                extra.setdefault(i, []).append(("net", s, e))
            rows = []
            for i, base in enumerate(bases):
                every = sorted([*base, *extra.get(i, [])], key=lambda x: (x[1], (*KINDS, "net").index(x[0])))
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(extra.get(i, [])), len(tokens[i])))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_net", "n_candidates"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long, n_candidates long")
