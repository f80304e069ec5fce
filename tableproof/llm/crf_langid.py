"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has the character n-grams of its letters between boundary marks (those at a boundary are its affixes) and, if
it is frequent enough, its entry in a learned lexicon. The field adds learned transitions between the languages of
neighbouring words, so stretches of code-switched text are told apart; forward-backward gives each word's posterior and
a document's language is the one with the greatest share of its words with letters.

The field is fitted on the driver by stochastic gradient ascent of the conditional likelihood, on a bounded sample of
labelled documents (LangIdSpec.sample_docs a language, sample_total in all) cut into stretches and strung together, so that it sees switches.
Prediction reads every whole text. Forward and backward passes run over a whole batch at once: the chain is cut into
blocks whose transfer matrices are multiplied side by side, which is exact.

Nulls: a null text, or one without letters, is "und" with score 0. With no labelled documents all texts are "und".
Repeated rows and null ids are each labelled (a null id is never held out); an empty table gives an empty result. The
input's columns come as one struct, so none of their names can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import broadcast_if, give_back, hold, ship

ship(__name__)

UNKNOWN = "und"


@dataclass(frozen=True)
class LangIdSpec:
    #: Labelled documents of each language that the field is fitted on, about (chosen by a hash of their id), how many
    #: of all languages, in even shares, and the longest of them in characters; longer ones are not used for fitting.
    sample_docs: int = 300
    sample_total: int = 3_000
    sample_chars: int = 50_000
    orders: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 16
    lexicon_words: int = 20_000
    lexicon_count: int = 4
    epochs: int = 3
    stretch: int = 40
    length: int = 64
    batch: int = 64
    rate: float = 0.3
    decay: float = 1e-6
    seed: int = 7


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # (buckets + lexicon, labels)
    transitions: np.ndarray  # (labels, labels), logarithms
    start: np.ndarray
    lexicon: dict[str, int]
    spec: LangIdSpec = field(default_factory=LangIdSpec)


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words of the texts in turn, the distinct words as their letters (lower case), the texts' offsets."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.utf8_split_whitespace(lowered)
    codes = pc.dictionary_encode(lists.flatten())
    letters = pc.replace_substring_regex(codes.dictionary, pattern=r"[^\p{L}]+", replacement="")
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), letters.to_pylist(), lists.offsets.to_numpy().astype(np.int64)


def features(words: list[str], lexicon: dict[str, int], spec: LangIdSpec) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words in turn, and the offsets of each word's in them (words without letters have none)."""
    marked = [f"\x02{w}\x03" if w else "" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    end_of = np.repeat(ends, size)
    word_of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(chars))
    numbers, owners, rolled = [], [], chars * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, max(spec.orders) + 1):
        rolled = rolled[:-1] if len(rolled) else rolled
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + chars[n - 1 :][: len(rolled)]
        if n in spec.orders:
            inside = at[: len(rolled)] + n <= end_of[: len(rolled)]
            mixed = rolled[inside] * np.uint64(0x94D049BB133111EB)
            numbers.append(((mixed >> np.uint64(40)) % np.uint64(spec.buckets)).astype(np.int64))
            owners.append(word_of[: len(rolled)][inside])
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    numbers.append(np.array([spec.buckets + k for _, k in known], np.int64))
    owners.append(np.array([i for i, _ in known], np.int64))
    number, owner = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return number[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the rows of values between each two offsets; zero for empty stretches."""
    out = np.zeros((len(offsets) - 1, values.shape[1]), values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def forward_backward(emit: np.ndarray, first: np.ndarray, model_transitions: np.ndarray, start: np.ndarray, block: int = 128) -> np.ndarray:
    """Posteriors (words, labels) of a run of chains. emit: log scores of each word; first: True where a chain begins."""
    n, k = emit.shape
    if not n:
        return np.zeros((0, k))
    rows = -(-n // block)
    pad = rows * block - n
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(rows, block, k)
    begins = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, block)
    step, begin = np.exp(model_transitions), np.tile(np.exp(start), (k, 1))
    # each block's transfer matrix: the product of its words' steps
    product = np.tile(np.eye(k), (rows, 1, 1))
    for t in range(block):
        moved = product @ step
        new = begins[:, t]
        if new.any():
            moved[new] = product[new] @ begin
        product = moved * e[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((rows, k)), np.empty((rows, k))
    v = np.full(k, 1 / k)
    for r in range(rows):
        ahead[r] = v
        v = v @ product[r]
        v /= v.sum()
    v = np.ones(k)
    for r in range(rows - 1, -1, -1):
        behind[r] = v
        v = product[r] @ v
        v /= v.sum()
    alpha = np.empty((rows, block, k))
    a = ahead
    for t in range(block):
        moved = a @ step
        new = begins[:, t]
        moved[new] = np.exp(start)
        a = moved * e[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    b = behind
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= b
        onward = e[:, t] * b
        b = onward @ step.T
        new = begins[:, t]
        b[new] = (onward[new] @ np.exp(start))[:, None]
        b /= b.sum(axis=1, keepdims=True)
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha.reshape(-1, k)[:n]


def fit(rows: list[tuple[str, str]], spec: LangIdSpec = LangIdSpec()) -> Field:
    """The field fitted on (text, language) rows."""
    labels = sorted({lang for _, lang in rows})
    k = len(labels)
    codes, words, offsets = tokens(pa.array([t for t, _ in rows], pa.large_string()))
    tag_of = np.repeat([labels.index(lang) for _, lang in rows], np.diff(offsets)).astype(np.int64) if rows else np.zeros(0, np.int64)
    counts = np.bincount(codes, minlength=len(words))
    by_word: dict[str, int] = {}
    for w, c in zip(words, counts, strict=True):
        if w:
            by_word[w] = by_word.get(w, 0) + int(c)
    frequent = sorted((w for w, c in by_word.items() if c >= spec.lexicon_count), key=lambda w: (-by_word[w], w))[: spec.lexicon_words]
    lexicon = {w: i for i, w in enumerate(frequent)}
    model = Field(labels, np.zeros((spec.buckets + len(lexicon), k)), np.zeros((k, k)), np.zeros(k), lexicon, spec)
    if k < 2:
        return model
    parts = [features(words[lo : lo + 20_000], lexicon, spec) for lo in range(0, len(words), 20_000)]
    number = np.concatenate([p[0].astype(np.int32) for p in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    del parts, by_word
    random = np.random.default_rng(spec.seed)
    seen_w, seen_t = np.full(model.weights.shape, 1e-2), np.full((k, k), 1.0)
    # stretches of one language each
    pieces = []
    for i in range(len(rows)):
        cut = offsets[i]
        while cut < offsets[i + 1]:
            long = int(random.geometric(1 / spec.stretch)) + 4
            pieces.append((cut, min(cut + long, offsets[i + 1])))
            cut += long
    # languages with few words are repeated, up to the mean
    per = np.bincount(tag_of, minlength=k)
    spread = [list(np.flatnonzero([tag_of[a] == c for a, _ in pieces])) for c in range(k)]
    for _ in range(spec.epochs):
        chosen = [j for c in range(k) for j in (spread[c] * int(min(8, max(1, round(per.mean() / max(per[c], 1))))))]
        random.shuffle(chosen)
        run = np.concatenate([np.arange(*pieces[j]) for j in chosen]) if chosen else np.zeros(0, np.int64)
        size = spec.length * spec.batch
        for lo in range(0, len(run) - spec.length + 1, size):
            part = run[lo : lo + size]
            part = part[: len(part) // spec.length * spec.length]
            used, where = np.unique(codes[part], return_inverse=True)
            spans = at[used + 1] - at[used]
            flat_at = np.concatenate([[0], np.cumsum(spans)])
            flat = number[np.repeat(at[used] - flat_at[:-1], spans) + np.arange(flat_at[-1])]
            emit_words = sums(model.weights[flat], flat_at)
            emit = emit_words[where].reshape(-1, spec.length, k)
            gold = tag_of[part].reshape(-1, spec.length)
            gamma, pairs = _chains(emit, model.transitions, model.start)
            error = -gamma
            np.put_along_axis(error, gold[:, :, None], np.take_along_axis(error, gold[:, :, None], 2) + 1, 2)
            by = np.stack([np.bincount(where.ravel(), error[:, :, c].ravel(), minlength=len(used)) for c in range(k)], 1)
            owner = np.repeat(np.arange(len(used)), spans)
            grad = np.stack([np.bincount(flat, by[owner, c], minlength=len(model.weights)) for c in range(k)], 1) - spec.decay * model.weights
            seen_w += grad * grad
            model.weights += spec.rate * grad / np.sqrt(seen_w)
            gold_pairs = np.zeros((k, k))
            np.add.at(gold_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            grad_t = (gold_pairs - pairs) / spec.batch
            seen_t += grad_t * grad_t
            model.transitions += spec.rate * grad_t / np.sqrt(seen_t)
    model.weights = model.weights.astype(np.float32)
    return model


def _chains(emit: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and expected transition counts of chains of equal length (chains, words, labels)."""
    chains, length, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    step = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = np.exp(start) * e[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ step) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    onward = e[:, 1:] * beta[:, 1:]
    joint = alpha[:, :-1, :, None] * step[None, None] * onward[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return gamma, joint.sum(axis=(0, 1))


def shares(texts: pa.Array, model: Field, words_at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Share of each label among each text's words with letters, and the number of those words."""
    codes, words, offsets = tokens(texts)
    k = len(model.labels)
    emit = np.zeros((len(words), k), np.float32)
    has = np.fromiter((bool(w) for w in words), bool, len(words))
    for lo in range(0, len(words), 20_000):  # the features of so many words are in memory at once
        number, at = features(words[lo : lo + 20_000], model.lexicon, model.spec)
        emit[lo : lo + 20_000] = sums(model.weights[number], at)
    out, lettered = np.zeros((len(offsets) - 1, k)), np.zeros(len(offsets) - 1, np.int64)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + words_at_once, "right")) - 1)
        part = codes[offsets[lo] : offsets[hi]]
        first = np.zeros(len(part), bool)
        inside = offsets[lo : hi + 1] - offsets[lo]
        first[inside[:-1][np.diff(inside) > 0]] = True
        post = forward_backward(emit[part].astype(np.float64), first, model.transitions, model.start) if k > 1 else np.ones((len(part), k))
        mask = has[part]
        out[lo:hi] = sums(post * mask[:, None], inside)
        lettered[lo:hi] = sums(mask[:, None].astype(np.int64), inside)[:, 0]
        lo = hi
    return out / np.maximum(lettered, 1)[:, None], lettered


def portions(texts: pd.Series, chars: int = 1_000_000) -> Iterator[pa.Array]:
    """The texts in turn, in arrays of about so many characters (or one longer text)."""
    sizes = texts.str.len().fillna(0).to_numpy(dtype=np.int64)
    part = np.cumsum(sizes) // chars
    for p in np.unique(part):
        yield pa.array(texts[part == p], pa.large_string(), from_pandas=True)


def training_sample(docs: DataFrame, spec: LangIdSpec, id_column: str, text_column: str, lang_column: str, usable: Column) -> list[tuple[str, str]]:
    """Up to about spec.sample_docs (text, language) rows a language and spec.sample_total in all, by hashes of their id."""
    labelled = docs.where(usable & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    counts = hold(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    each = min(spec.sample_docs, spec.sample_total / max(counts.count(), 1))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    short = labelled.where(F.length("text") <= spec.sample_chars).withColumn("draw", draw)
    rows = short.join(broadcast_if(counts, 10_000), "lang").where(F.col("draw") < F.lit(each) / F.col("n")).select("id", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["id"] or "", r["lang"], r["text"]))]


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, spec: LangIdSpec = LangIdSpec(), *, model: Field | None = None, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """docs' rows as struct column row, with lang_pred, score, words (with letters) and label_shares beside it."""
    if model is None:
        model = fit(training_sample(docs, spec, id_column, text_column, lang_column, ~held_out(F.col(id_column))), spec)
        give_back()
    plain = {k: v for k, v in vars(model).items() if k != "spec"}
    held, labels, spec = docs.sparkSession.sparkContext.broadcast(plain), model.labels, model.spec

    @F.pandas_udf("lang string, score double, words long, shares array<double>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Field(**held.value, spec=spec)
        for batch in batches:
            share, lettered = np.zeros((len(batch), len(labels))), np.zeros(len(batch), np.int64)
            done = 0
            for texts in portions(batch) if labels else ():
                share[done : done + len(texts)], lettered[done : done + len(texts)] = shares(texts, model)
                done += len(texts)
            known = lettered > 0
            best = share.argmax(axis=1) if labels else np.zeros(len(batch), np.int64)
            names = np.array([*labels, UNKNOWN], object)
            pick = np.where(known, best, len(labels))
            score = np.where(known, share.max(axis=1, initial=0.0), 0.0)
            yield pd.DataFrame({"lang": names[pick], "score": np.clip(score, 0.0, 1.0), "words": lettered, "shares": [list(map(float, s)) for s in share]})
        give_back()

    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", label(F.col("row")[text_column].cast("string")).alias("p")).select("row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.words").alias("words"), F.map_from_arrays(F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>"), F.col("p.shares")).alias("label_shares"))


def readable(docs: DataFrame, spec: LangIdSpec = LangIdSpec(), *, least: float = 0.4, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of docs in a known language: "und" ones and those with no language at share least go."""
    found = identify(docs, spec, id_column=id_column, text_column=text_column, lang_column=lang_column)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
