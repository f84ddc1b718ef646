"""Problem 2: the subject areas of each document, by classifier chains over term, source and structure features.

Terms: a generative term model tells what each sentence speaks of, if anything. It is fitted by expectation maximisation
on a bounded sample, from the hand-given labels and from those categories that spell a subject; the reliability of every
other category is learned on the way. Chains: per subject, in order of frequency, a ridge-regularised logistic
regression over what the terms say of the document (how many of its sentences speak of the subject, how surely, how
strong the terms are taken together, and what speaks of other subjects), its structure (sentences, record or prose), its
category and source, and the labels earlier in the chain, which models the co-occurrence of subjects. They are fitted on
the hand-given labels and, with the weight PSEUDO, on what the terms alone would give the other rows of the sample. Each
link is calibrated on the fold that it was not fitted on (Platt scaling). Beam search decodes the likeliest combination of
labels; that combination is the result, no rule comes after it.

Scale: the fit is on the driver, over LABELLED labelled and UNLABELLED other rows at most, chosen by hash among those of
SAMPLE_CHARS characters at most; decoding is one pass over all rows and whole texts without a shuffle, with a 9 MB model
broadcast.

Defined results: null, blank and subjectless texts have no row; labels that name no listed subject are ignored, a null
label counts as none; repeated rows are reported as often as they occur; a text without any sentence mark is one sentence;
a table of labels without any row leaves the chains to what the categories say.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pii import CAPITAL, GIVEN, NAME_CJK
from tessera.llm.sample import by_hash
from tessera.llm.vec import CHUNK_CHARS, Units, chunks, mix

#: Rows of the bounded sample: labelled ones, and others that the term model learns from.
LABELLED, UNLABELLED, SAMPLE_CHARS = 5_000, 10_000, 4_000
BITS = 18
ROUNDS = 8
#: A term speaks when PURE of its mass is in one class, and it was seen SEEN times.
PURE, SEEN = 0.7, 4
#: Units in fewer of this many sentences, or only once, pass for names where recurring sentences are looked for.
COMMON = 2_000
#: A sentence has no subject, with this prior: a single term that occurs elsewhere as well is not enough for one.
NO_SUBJECT, REFERENCE_NONE = 0.95, 0.99999
#: The round from which on that prior holds in the fit; before, the small languages' terms must form.
CAUTIOUS_FROM = 4
BEAM = 6
SHARE = (1, 3)
#: What a row without a label counts for in the fit of the chains.
PSEUDO = 0.3
#: Categories, and sources, that are told apart in the chains: the most frequent of the sample.
KNOWN = 64
STRONG = 20.0  # where the evidence of a document's terms is cut

RECORD = re.compile(r"^\s*(?:[{|]|-{3}\s*\n|[\w ]{1,24}\s*[:：=][^\n]{0,80}(?:\n[\w ]{1,24}\s*[:：=]|;\s*[\w ]{1,24}=))")
CUT = re.compile(r"(?<=[。！？!?])\s*|(?<=\w\.)(?=[\s\"”'*)]|[A-ZÄÖÜÁÉÍÓÚ一-鿿])\s*|(?<=%\.)\s*|(?<=\)\.)\s*|(?<=\.\.\.)\s*|(?<=…)\s*")


#: What stands in sentences that only refer (order and phone numbers, machines, links, people): long or joined numbers and codes.
REFERENCE = re.compile(r"\d{6,}|\d-\d{3,}|\d\.\d+\.\d|@|＠|https?://|\b(?=[a-z]*\d)(?=\d*[a-z])[0-9a-z]{9,}\b")
REFERENCE_CHARS = 90
SHORTEST_CHARS = 14  # Latin; shorter pieces come of abbreviations


def refers(sentence: str) -> bool:
    """Whether a sentence only refers to a number, a link or a person, or is a mere piece."""
    if len(sentence) >= REFERENCE_CHARS:
        return False
    if REFERENCE.search(sentence) or len(sentence) < SHORTEST_CHARS and sentence.isascii():
        return True
    return any(w in GIVEN for w in CAPITAL.findall(sentence)) or not sentence.isascii() and bool(NAME_CJK.search(sentence))


def sentences(text: str) -> list[str]:
    """The sentences of a text; a record is one. A title without a sentence mark belongs to the sentence after it."""
    if RECORD.match(text):
        return [text]
    return [s for s in CUT.split(text) if s and not s.isspace()]


def terms(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms (words, pairs of words, pairs of CJK characters) and the sentence of each."""
    u = Units(parts, mask_numbers=True)
    if not len(u.h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.zeros(len(u.h), bool)
    pair[:-1] = (u.doc[1:] == u.doc[:-1]) & (u.cjk[1:] == u.cjk[:-1])
    at = np.flatnonzero(pair)
    two = mix(u.h[at] * np.uint64(31) + u.h[at + 1])
    single = ~u.cjk
    h = np.concatenate([u.h[single], two])
    row = np.concatenate([u.doc[single], u.doc[at]])
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64), row


@dataclass
class TermModel:
    """log P(term | class), subjects first and none last."""

    weights: np.ndarray

    def priors(self, parts: list[str]) -> np.ndarray:
        k = self.weights.shape[1] - 1
        none = np.where([refers(s) for s in parts], REFERENCE_NONE, NO_SUBJECT)[:, None]
        return np.concatenate([np.repeat((1 - none) / k, k, axis=1), none], axis=1)

    def posterior(self, index: np.ndarray, row: np.ndarray, rows: int, prior: np.ndarray) -> np.ndarray:
        scores = np.stack([np.bincount(row, weights=self.weights[index, c], minlength=rows) for c in range(self.weights.shape[1])], axis=1).astype(float)
        scores += np.log(prior)
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        return p / p.sum(axis=1, keepdims=True)


def fit_terms(texts: list[str], labels: list[set[int] | None], categories: list[str], seeds: dict[str, int], k: int) -> TermModel:
    """Expectation maximisation over sentences. labels: subjects given by hand (empty: none), or None; seeds: category to subject."""
    parts, of = [], []
    for i, t in enumerate(texts):
        for s in sentences(t):
            parts.append(s)
            of.append(i)
    # A stock sentence that recurs but for its numbers and names counts once, or its wording would pass for a subject's.
    units = Units(parts, mask_numbers=True)
    _, number, count = np.unique(units.h, return_inverse=True, return_counts=True)
    common = count[number] >= max(2, len(parts) // COMMON)
    mark = np.zeros(len(parts), np.uint64)
    np.add.at(mark, units.doc[common], mix(units.h[common] + np.uint64(1)))
    once = np.sort(np.unique(mark, return_index=True)[1])
    parts, of = [parts[i] for i in once], np.array(of)[once]
    blocks = [(p.start, *terms(parts[p])) for p in chunks([len(s) for s in parts])]
    index = np.concatenate([b[1] for b in blocks]).astype(np.int32)
    row = np.concatenate([b[2] + b[0] for b in blocks]).astype(np.int32)
    by_category = {c: np.full(k + 1, 1.0 / (k + 1)) for c in set(categories)}
    for c in by_category:
        if c in seeds:
            by_category[c] = np.full(k + 1, 0.3 / k)
            by_category[c][seeds[c]] = 0.7
    total = np.bincount(index, minlength=1 << BITS) + 0.0
    background = (total + 0.1) / (total + 0.1).sum()

    def node_prior() -> np.ndarray:
        out = np.empty((len(texts), k + 1))
        for i, (given, category) in enumerate(zip(labels, categories)):
            p = by_category[category].copy()
            if given is not None:
                p *= 0.25
                for s in given or {k}:
                    p[s] += 0.75 / max(1, len(given))
            out[i] = p * 0.9 + 0.1 / (k + 1)
        return out

    prior = node_prior()[of]
    post = prior.copy()
    model = TermModel(np.zeros((1 << BITS, k + 1), np.float32))
    cautious = model.priors(parts)
    referring = cautious[:, k] > NO_SUBJECT
    for r in range(ROUNDS):
        for c in range(k + 1):
            count = np.bincount(index, weights=post[row, c], minlength=1 << BITS)
            # Smoothed towards the whole collection, so that terms of no subject favour none.
            p = (count + 2.0 * background) / (count.sum() + 2.0)
            model.weights[:, c] = np.log(p) - np.log(background)
        np.clip(model.weights, -4, 6, out=model.weights)
        if r >= 2:
            # Only terms that are seen often enough and belong to one class speak; the wording of sentences must not add up.
            odds = np.exp(model.weights) * post.mean(axis=0)
            neutral = (odds.max(axis=1) < PURE * odds.sum(axis=1)) | (total < SEEN)
            model.weights[neutral] = 0
        # The category says less and less as the terms become reliable.
        power = max(0.15, 0.8 ** (r + 1))
        held_back = cautious if r >= CAUTIOUS_FROM else np.where(referring[:, None], cautious, 1.0)
        post = model.posterior(index, row, len(parts), prior**power * held_back)
        if r >= 2:
            sums: dict[str, np.ndarray] = {}
            mass = np.zeros((len(texts), k + 1))
            np.add.at(mass, of, post)
            for i, c in enumerate(categories):
                sums[c] = sums.get(c, np.full(k + 1, 0.5)) + mass[i]
            by_category = {c: v / v.sum() for c, v in sums.items()}
            prior = node_prior()[of]
    return model


def ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression of weighted rows by Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + penalty * w
        h = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def about(count: np.ndarray) -> np.ndarray:
    """The subjects that the terms alone give: a third of the subject-bearing sentences, as 0 or 1."""
    return ((count > 0) & (count * SHARE[1] >= count.sum(axis=1, keepdims=True) * SHARE[0])) * 1.0


@dataclass
class Chains:
    subjects: list[str]
    terms: TermModel
    order: np.ndarray
    links: np.ndarray  # one row of weights for each link, in chain order
    scale: np.ndarray  # Platt's a and b of each link
    categories: dict[str, int]
    sources: dict[str, int]

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sentences about each subject, what the terms say of each (text, subject, measure), and the structure."""
        k = len(self.subjects)
        parts, of = [], []
        for i, t in enumerate(texts):
            for s in sentences(t) if t else ():
                parts.append(s)
                of.append(i)
        count, mass, evidence = np.zeros((len(texts), k)), np.zeros((len(texts), k + 1)), np.zeros((len(texts), k + 1))
        surest = np.zeros((len(texts), k))
        if parts:
            index, row = terms(parts)
            post = self.terms.posterior(index, row, len(parts), self.terms.priors(parts))
            of = np.array(of)
            best = post.argmax(axis=1)
            speaks = best < k
            np.add.at(count, (of[speaks], best[speaks]), 1)
            np.add.at(mass, of, post)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            surest[of[first]] = np.maximum.reduceat(post[:, :k], first, axis=0)
            for c in range(k + 1):
                evidence[:, c] = np.bincount(of[row], weights=self.terms.weights[index, c], minlength=len(texts))
        total = count.sum(axis=1, keepdims=True)
        share = count / np.maximum(total, 1)
        soft = mass[:, :k] / np.maximum(mass[:, :k].sum(axis=1, keepdims=True), 1e-9)
        strength = np.clip(evidence[:, :k] - evidence[:, k:], -STRONG, STRONG) / STRONG
        record = np.array([bool(t) and bool(RECORD.match(t)) for t in texts], float)
        structure = np.stack([np.log1p(total[:, 0]), record, (total[:, 0] == 0) * 1.0], axis=1)
        return count, np.stack([share, about(count), soft, surest, strength], axis=2), structure

    def slots(self, categories: list[str], sources: list[str | None]) -> np.ndarray:
        """One column for each known category and source, the last of either for all others."""
        c, s = len(self.categories), len(self.sources)
        out = np.zeros((len(categories), c + s + 2))
        out[np.arange(len(out)), [self.categories.get(x, c) for x in categories]] = 1
        out[np.arange(len(out)), [c + 1 + self.sources.get(x or "", s) for x in sources]] = 1
        return out

    def link_features(self, said: np.ndarray, rest: np.ndarray, link: int, before: np.ndarray) -> np.ndarray:
        """Features of one link: the measures of its own subject, the strongest of the others, structure and source, earlier labels."""
        own = said[:, self.order[link]]
        others = np.delete(said, self.order[link], axis=1).max(axis=1, initial=0)
        earlier = np.zeros((len(said), len(self.subjects)))
        earlier[:, :link] = before
        return np.concatenate([own, others, rest, earlier, np.ones((len(said), 1))], axis=1)

    def decode(self, said: np.ndarray, rest: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest combination of labels of each text, and the calibrated mass of each subject over the beam."""
        n, k = len(said), len(self.subjects)
        labels, logp = np.zeros((n, 1, 0)), np.zeros((n, 1))
        for link in range(k):
            width = labels.shape[1]
            # The features but for the earlier labels are the same for the whole beam.
            w = self.links[link]
            at = len(w) - 1 - k
            z = (self.link_features(said, rest, link, np.zeros((n, link))) @ w)[:, None] + labels @ w[at : at + link]
            z = self.scale[link, 0] * z + self.scale[link, 1]
            p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
            both = np.concatenate([logp + np.log(1 - p), logp + np.log(p)], axis=1)
            grown = np.concatenate(
                [np.concatenate([labels, np.zeros((n, width, 1))], axis=2), np.concatenate([labels, np.ones((n, width, 1))], axis=2)], axis=1
            )
            best = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            logp = np.take_along_axis(both, best, axis=1)
            labels = np.take_along_axis(grown, best[:, :, None], axis=1)
        p = np.exp(logp - logp.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        chosen, mass = np.zeros((n, k), bool), np.zeros((n, k))
        chosen[:, self.order] = labels[:, 0] > 0
        mass[:, self.order] = (labels * p[:, :, None]).sum(axis=1)
        return chosen, mass

    def subjects_of(self, texts: list[str | None], categories: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, subject number) of each decoded label, and its mass."""
        _, said, structure = self.measure(texts)
        rest = np.concatenate([structure, self.slots([tidy(c) for c in categories], sources)], axis=1)
        chosen, mass = self.decode(said, rest)
        chosen[np.array([not t or t.isspace() for t in texts], bool)] = False
        return np.argwhere(chosen), mass[chosen]


def tidy(category: str | None) -> str:
    return (category or "").strip().lower()


def train(rows: list[tuple[str, str | None, str | None, list[str | None] | None]], subjects: list[tuple[str, str | None]]) -> Chains:
    """Fit on rows of (text, category, source, labels or None); subjects are (name, other name)."""
    names = [s for s, _ in subjects]
    number = {s: i for i, s in enumerate(names)}
    seeds = {tidy(x): i for i, (s, other) in enumerate(subjects) for x in (s, other) if x}
    texts = [r[0] for r in rows]
    categories = [tidy(r[1]) for r in rows]
    given = [None if r[3] is None else {number[x] for x in r[3] if x in number} for r in rows]
    k = len(names)
    model = fit_terms(texts, given, categories, seeds, k)
    frequency = Counter(s for g in given if g for s in g)
    order = np.array(sorted(range(k), key=lambda s: (-frequency[s], s)))
    known = lambda values: {x: i for i, (x, _) in enumerate(sorted(Counter(values).items(), key=lambda c: (-c[1], c[0]))[:KNOWN])}
    chains = Chains(names, model, order, np.zeros((k, 0)), np.tile([1.0, 0.0], (k, 1)), known(categories), known(r[2] or "" for r in rows))
    count, said, structure = chains.measure(texts)
    rest = np.concatenate([structure, chains.slots(categories, [r[2] for r in rows])], axis=1)
    y = about(count)
    for i, g in enumerate(given):
        if g is not None:
            y[i] = 0
            y[i, list(g)] = 1
    weight = np.array([PSEUDO if g is None else 1.0 for g in given])
    fold = np.arange(len(rows)) % 2
    links = []
    for link in range(k):
        x = chains.link_features(said, rest, link, y[:, order[:link]])
        target = y[:, order[link]]
        links.append(ridge(x, target, weight))
        z = np.zeros(len(rows))
        for f in (0, 1):
            if (fold != f).any():
                z[fold == f] = x[fold == f] @ ridge(x[fold != f], target[fold != f], weight[fold != f])
        chains.scale[link] = ridge(np.stack([z, np.ones(len(z))], axis=1), target, weight, 1e-3)
    chains.links = np.array(links)
    return chains


def fit_on(nodes: DataFrame, labels: DataFrame, subjects: DataFrame) -> Chains:
    """Fit on the bounded sample of (id, text, category, source), (node_id, subject) and the subjects' table, which is small."""
    listed = subjects.filter("subject is not null").groupBy("subject").agg(F.min("label_zh").alias("label_zh"))
    areas = [(r.subject, r.label_zh) for r in listed.orderBy("subject").collect()]
    short = nodes.select("id", "text", "category", "source").filter(F.length("text").between(1, SAMPLE_CHARS))
    given = labels.filter("node_id is not null").groupBy("node_id").agg(F.collect_set("subject").alias("labels"))  # a null label leaves an empty set
    given = by_hash(given, "node_id", LABELLED)
    labelled = short.join(F.broadcast(given), short.id == given.node_id)  # at most LABELLED rows
    # The others by hash alone; a labelled row among them is dropped here, on the driver, where both samples are.
    rest = by_hash(short, "id", UNLABELLED)
    first = labelled.orderBy("id").select("id", "text", "category", "source", "labels").collect()
    known = {r.id for r in first}
    rows = [(r.text, r.category, r.source, list(r.labels)) for r in first]
    rows += [(r.text, r.category, r.source, None) for r in rest.collect() if r.id not in known]
    return train(rows, areas)


def _assign(batches: Iterator[pa.RecordBatch], chains: Chains) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("text", "category", "source")]
        at, subject, mass = [np.zeros(0, np.int64)], [], [np.zeros(0)]
        for part in chunks([len(t or "") for t in columns[0]], CHUNK_CHARS // 2):
            where, own = chains.subjects_of(*(c[part] for c in columns))
            at.append(where[:, 0] + part.start)
            subject += [chains.subjects[s] for s in where[:, 1]]
            mass.append(own)
        ids = batch.column("id").take(pa.array(np.concatenate(at)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(subject, pa.string()), pa.array(np.concatenate(mass))], names=["node_id", "subject", "mass"])


def assign(nodes: DataFrame, chains: Chains) -> DataFrame:
    """(node_id, subject, mass): the subjects of every node of (id, text, category, source)."""
    shared = nodes.sparkSession.sparkContext.broadcast(chains)
    named = nodes.select(F.col("id").cast("long").alias("id"), "text", "category", "source")
    return named.mapInArrow(lambda it: _assign(it, shared.value), "node_id long, subject string, mass double")


def composition(assigned: DataFrame) -> DataFrame:
    """(subject, nodes, weight): how many nodes speak of each subject, and the sum of their shares among the node's subjects."""
    each = assigned.withColumn("part", 1 / F.count(F.lit(1)).over(_window()))
    return each.groupBy("subject").agg(F.countDistinct("node_id").alias("nodes"), F.round(F.sum("part"), 6).alias("weight"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("node_id")
