"""Problem 8: template residue, filler, error pages and script notices in place of content.

Method: a regularised linear classifier on hashed n-grams, length, title and wording features. Its labels are weak ones:
response statuses ("404 Not Found") and stock phrases in four languages; what only mentions such a phrase (in quotes, or
amid longer text) is labelled as content. Filler has no list: its segments are known by their wording. They repeat
themselves, or they are runs of words without any of the small words that every language needs, made of words that hardly
ever stand in a sentence that has some (`company`). All else is unlabelled, not content: a first fit sets the labelled
residue against it with a smaller weight, and the second takes from it only what the first is sure of (positive-unlabelled
learning in two steps). It is fitted on segments (lines, and sentences in them) of a bounded sample of documents
(TRAIN_DOCS, by hash of the id) and validated on hosts that were held out. A document is residue when the segments so
classified hold more than half of its characters.

Scale: the fit runs on the driver over the sample only; scoring is one pass without a shuffle over all documents and whole
texts, with the weights (2^18 floats, 1 MB) broadcast.

Defined results: null, empty and blank documents are not residue (they hold nothing at all); without any weak positive in
the sample no document is residue; repeated documents are reported as often as they occur.
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

from tessera.llm.linear import Sparse, fit, sigmoid
from tessera.llm.sample import by_hash
from tessera.llm.vec import CHUNK_CHARS, Units, chunks, mix

#: Documents in the training sample, and the longest that it takes; both bound what the driver holds.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 6_000
SIZE = 1 << 18
SYMBOLS = "{}[]<>$%_#/【】《》…|=*"
RESIDUE_SHARE = 0.5
#: Words of a segment that wording can tell anything of, and those of one that repeats itself.
SAID, REPEATED = 6, 4
#: The share of a filler word's segments that may hold a small word, and how often a word must be seen to tell.
COMPANY, SEEN = 0.2, 3
#: What an unlabelled segment counts for in the first fit, beside a labelled one.
UNLABELLED = 0.3

# Small words of English, German, Spanish and French.
SMALL_WORDS = frozenset(
    "a about after all also an and any are as at be been before but by can could did do does for from had has have he her his how if in into is it its"
    " may more must no nor not of off on one or our out over she should so some such than that the their them then there these they this those to under up"
    " us was we were what when which while who will with without would you your"
    " ab aber als am auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer es für galt hat ich ihr im ist kann kein man mit"
    " nach nicht nur oder ohne sich sie sind über um und unter vom von vor war wenn werden wie wird wir zu zum zur"
    " al con cuando de del el en entre era es esta este fue hay la las le lo los más ni no o para pero por que se según ser si sin sobre son su sus un una y"
    " au aux avec ce ces dans du elle est et ils je les leur mais ne nous ou par pas plus pour qui sa son sur une vous".split()
)

# Stock phrases (lower case) and response statuses.
CUES = [
    r"\b(?:400|401|403|404|408|410|429|500|502|503|504)\b[ :-]*(?:bad request|unauthori[sz]ed|forbidden|not found|request timeout|gone|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)",
    r"\berror \d{3,6}\b", r"internal server error", r"access denied", r"page not found", r"something went wrong", r"could not be found",
    r"no longer (?:exists|available)", r"not available in your region", r"too many requests", r"session has expired", r"connection failed",
    r"do not have permission", r"took too long to", r"link seems broken", r"^oops", r"try again later", r"back to the home ?page",
    r"(?:you )?(?:need to )?(?:enable|turn on|requires?) (?:javascript|scripts?|cookies)", r"to (?:view|use) this (?:app|site|page|content)", r"may have been (?:moved|deleted|removed)(?: or (?:moved|deleted|removed))?", r"browser does not support", r"scripts? (?:are|is) disabled", r"needs cookies", r"checking your browser",
    r"loading, please wait", r"if you are not redirected",
    r"placeholder text", r"(?:your content|sample text|text) goes here", r"lorem ipsum", r"\bipsum\b.*\bdolor\b|\bdolor\b.*\bipsum\b", r"^(?:text ){2,}text", r"asdf asdf",
    r"404 - ", r"页面不存在", r"找不到该", r"网关错误", r"服务器(?:内部)?(?:错误|开小差)", r"内容加载失败", r"已被(?:发布者)?删除", r"登录已过期", r"没有权限", r"请求过于频繁", r"错误代码", r"系统繁忙", r"返回首页", r"已被删除或移动",
    r"请启用 ?javascript", r"开启 ?cookie", r"(?:您的)?浏览器已禁用脚本", r"安全检查中", r"正在加载", r"若未自动跳转",
    r"占位文字", r"示例文本", r"(?:测试){3,}", r"(?:内容){3,}", r"用来占位",
    r"seite nicht gefunden", r"interner serverfehler", r"zugriff verweigert", r"existiert nicht mehr", r"versuchen sie es später", r"zur startseite", r"javascript (?:ist deaktiviert|aktivieren)|aktivieren sie javascript", r"wird geladen", r"unterstützt keine", r"cookies (?:erforderlich|aktivieren)", r"platzhalter", r"blindtext", r"beispieltext", r"musterstra",
    r"página no encontrada", r"error \d+ del servidor", r"acceso denegado", r"ya no existe", r"inténtelo de nuevo", r"volver al inicio", r"active javascript", r"no admite scripts", r"requieren cookies", r"cargando, espere", r"texto de relleno", r"aquí va el texto", r"texto de ejemplo",
]
# The shapes of unfilled slots (lower case).
SLOTS = [
    r"\{\{[^{}]{1,40}\}\}", r"\$\{[^{}]{1,40}\}", r"\[\[[^\[\]]{1,40}\]\]", r"<%=?[^%]{1,40}%>", r"%[a-zäöüáéíóúñ_]{3,30}%", r"__[a-zäöüáéíóúñ_]{3,30}__", r"\{[a-z_]{3,20}\}",
    r"\[(?:insert|insertar|einfügen|date|datum|fecha|name)\b[^\]]*\]", r"\[[^\[\]\d]{1,16}\]\W*$", r"<(?:your|enter|hier|aquí|su|ihr)[^<>]{1,40}>", r"<在此[^<>]{1,30}>", r"[（(]此处填[^）)]{1,30}[）)]", r"【请填写[^】]{1,30}】",
    r"[:：|]\s*(?:x{3,}|tbd|todo|_{4,}|待补充|待定)[\s|]*$", r"^\W*(?:x{4,}|tbd|待补充|_{4,})\W*$", r"yyyy年mm月dd日", r"dd\.mm\.yyyy|yyyy-mm-dd",
]
CUE = re.compile("|".join(f"(?:{c})" for c in CUES))
SLOT = re.compile("|".join(f"(?:{c})" for c in SLOTS))
LATIN_WORD, CJK_CHAR = re.compile(r"[a-zà-öø-ÿ]{2,}"), re.compile("[一-鿿]")
ANY_WORD = re.compile(r"[a-zà-öø-ÿ]+(?:['’-][a-zà-öø-ÿ]+)*")
#: What no running text consists of: fields, figures, codes, links and rows.
FORMED = re.compile(r"[\d:=|{}\[\]<>/\\@#_]")
QUOTED = re.compile(r"[\"'“”‘’「」‚‘„«»][^\"'“”‘’「」„«»]{2,80}[\"'“”‘’「」“«»]")
CUT = re.compile(r"\n+|(?<=[。！？!?])|(?<=[.…])[ \t\xa0]+|</?\w[^<>\n]{0,80}>")
SKIP = re.compile(r"[\s\-*|>#]+")


def segments(text: str) -> list[str]:
    """The lines, and the sentences in them, of a text, without markup; headings only where there is nothing else."""
    parts = [s for s in (p.strip() for p in CUT.split(text)) if s and not SKIP.fullmatch(s)]
    return [s for s in parts if s[0] != "#"] or parts


def weak_label(segment: str) -> int:
    """1 residue by a stock phrase or an unfilled slot, 0 content that only mentions one, -1 neither.

    A phrase is mentioned where it is quoted, or where many other words stand beside it.
    """
    low = segment.lower()
    for pattern, words, characters in ((SLOT, 4, 6), (CUE, 5, 10)):
        first = pattern.search(low)
        if not first:
            continue
        if any(m.start() < first.start() and first.end() < m.end() for m in QUOTED.finditer(low)):
            return 0
        rest = pattern.sub(" ", low)
        return int(len(LATIN_WORD.findall(rest)) <= words and len(CJK_CHAR.findall(rest)) <= characters)
    return -1


@dataclass
class Wording:
    """How a segment is worded: its words, its small words, whether it repeats itself, and whether it is running text."""

    words: list[str]
    small: int
    repeats: bool
    running: bool

    @classmethod
    def of(cls, segment: str) -> Wording:
        low = segment.lower()
        words = ANY_WORD.findall(low)
        cjk = CJK_CHAR.findall(low)
        small = sum(w in SMALL_WORDS for w in words)
        pairs = list(zip(cjk, cjk[1:]))
        repeats = (
            len(words) >= REPEATED and not small and len(set(words)) * 2 <= len(words) and not cjk
            or len(pairs) >= 2 * REPEATED and len(set(pairs)) * 3 <= len(pairs) and not words
        )
        return cls(words, small, repeats, not cjk and not FORMED.search(segment))

    def number(self) -> int:
        """A class of wording, a feature: how many small words there are among how many, repetition, and running text."""
        share = 0 if not self.small else 1 + min(3, 8 * self.small // len(self.words))
        long = 0 if not self.words else 1 + (len(self.words) >= SAID)
        return ((share * 3 + long) * 2 + self.repeats) * 2 + self.running


def filler(wordings: list[Wording]) -> np.ndarray:
    """Which segments are filler by their wording, set against the company that their words keep in all of them."""
    seen, beside = Counter(), Counter()
    for w in wordings:
        own = set(w.words)
        seen.update(own)
        if w.small:
            beside.update(own)
    lone = {x for x, n in seen.items() if n >= SEEN and beside[x] <= COMPANY * n}

    def one(w: Wording) -> bool:
        known = [x for x in w.words if seen[x] >= SEEN]
        strange = sum(x in lone for x in known)
        return w.repeats or w.running and not w.small and len(w.words) >= SAID and strange * 4 >= 3 * len(w.words)

    return np.array([one(w) for w in wordings], bool)


def features(texts: list[str], titles: list[int], wordings: list[Wording] | None = None) -> Sparse:
    """Hashed features of segments: n-grams of one to three units, a length class, the title class of the document, the wording."""
    units = Units(texts, SYMBOLS, mask_numbers=True)
    h, doc = units.h, units.doc
    grams, rows = [h], [doc]
    for n, salt in ((2, 0x51), (3, 0xA7)):
        if len(h) >= n:
            same = doc[: len(h) - n + 1] == doc[n - 1 :]
            g = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                g = mix(g * np.uint64(31) + h[k : len(h) - n + 1 + k])
            grams.append((g + np.uint64(salt))[same])
            rows.append(doc[: len(h) - n + 1][same])
    size = np.minimum(np.log2(units.n + 1), 8).astype(np.uint64)
    each = np.arange(len(texts))
    worded = np.array([w.number() for w in wordings or map(Wording.of, texts)], np.uint64)
    grams += [mix(worded + np.uint64(4000)), mix(worded * np.uint64(16) + size + np.uint64(5000))]
    rows += [each, each]
    grams += [mix(size + np.uint64(1000)), mix(np.asarray(titles, np.uint64) + np.uint64(2000)), mix(size * np.uint64(8) + np.asarray(titles, np.uint64) + np.uint64(3000))]
    rows += [each, each, each]
    return Sparse(mix(np.concatenate(grams)) >> np.uint64(64 - 18), np.concatenate(rows), len(texts))


def title_class(title: str | None) -> int:
    """0 no title, 1 one word, 2 more."""
    if not title or not title.strip():
        return 0
    return 1 if title.isascii() and len(title.split()) == 1 else 2


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: On hosts held out: segments with a weak label, and the share of them classified alike.
    held_out: int = 0
    accuracy: float = float("nan")

    def shares(self, texts: list[str | None], titles: list[str | None]) -> np.ndarray:
        """The share of each text's characters in residue; 0 for blank texts."""
        pieces, of = [], []
        for i, t in enumerate(texts):
            for s in segments(t) if t else ():
                pieces.append(s)
                of.append(i)
        total, residue = np.zeros(len(texts)), np.zeros(len(texts))
        if not pieces:
            return total
        kind = [title_class(t) for t in titles]
        of = np.array(of)
        x = features(pieces, [kind[i] for i in of])
        is_residue = x.score(self.weights, self.bias) > 0
        length = np.fromiter(map(len, pieces), float, len(pieces))
        np.add.at(total, of, length)
        np.add.at(residue, of[is_residue], length[is_residue])
        return residue / np.maximum(total, 1)


def train(rows: list[tuple[str, str | None, str]]) -> Model:
    """Fit on (text, title, host) rows, a fifth of the hosts being held out for validation first."""
    pieces, kinds, hosts, of = [], [], [], []
    for i, (text, title, host) in enumerate(rows):
        own = segments(text)
        pieces += own
        kinds += [title_class(title)] * len(own)
        hosts += [host] * len(own)
        of += [i] * len(own)
    y = np.array([weak_label(s) for s in pieces])  # 1 residue, 0 a mention, -1 unlabelled
    if not len(y):
        return Model(np.zeros(SIZE), -30.0)
    wordings = [Wording.of(s) for s in pieces]
    y[filler(wordings)] = 1
    if not (y == 1).any():
        return Model(np.zeros(SIZE), -30.0)
    # What stands beside residue is as likely residue itself, and no part of the first fit.
    of = np.array(of)
    beside = (y < 0) & (np.bincount(of, weights=y == 1)[of] > 0)
    x = features(pieces, kinds, wordings)
    names = sorted({h for h in hosts if h}, key=lambda h: (sum(map(ord, h)) * 31 % 97, h))
    out = set(names[: max(1, len(names) // 5)])  # documents without a host are never held out
    held = np.array([h in out for h in hosts])

    def fitted(which: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        part, weight = target[which], weight[which].astype(float)
        for c in (0, 1):
            weight[part == c] *= 0.5 / max(weight[part == c].sum(), 1e-9)
        return fit(x.take(which), part.astype(float), SIZE, weight)

    def twice(inside: np.ndarray) -> tuple[np.ndarray, float]:
        target = np.maximum(y, 0)
        w, b = fitted(inside[~beside[inside]], target, np.where(y < 0, UNLABELLED, 1.0))
        p = sigmoid(x.score(w, b))
        sure = np.where(p > 0.9, 1, np.where(p < 0.1, 0, -1))
        target = np.where(y >= 0, y, sure)
        return fitted(inside[target[inside] >= 0], target, np.ones(len(y)))

    model = Model(np.zeros(SIZE), 0.0)
    inside, outside = np.flatnonzero(~held), np.flatnonzero((y >= 0) & held)
    if len(outside) and (y[inside] == 1).any():
        w, b = twice(inside)
        model.held_out = len(outside)
        model.accuracy = float(((x.take(outside).score(w, b) > 0) == (y[outside] == 1)).mean())
    model.weights, model.bias = twice(np.arange(len(y)))
    return model


def fit_on(documents: DataFrame, docs: int = TRAIN_DOCS) -> Model:
    """Fit on the bounded sample of (doc_id, title, text, source_url)."""
    host = F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^https?://([^/]+)", 1)
    short = documents.select("doc_id", "title", "text", host.alias("host")).filter(F.length("text").between(1, TRAIN_CHARS))
    rows = by_hash(short, "doc_id", docs).collect()
    return train([(r.text, r.title, r.host) for r in rows])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, titles = batch.column("text").to_pylist(), batch.column("title").to_pylist()
        shares = [model.shares(texts[p], titles[p]) for p in chunks([len(t or "") for t in texts], CHUNK_CHARS // 2)]
        share = np.concatenate(shares) if shares else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(share)], names=["doc_id", "share"])


def scored(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, share): the share of each document's characters that is residue."""
    model = model or fit_on(documents)
    light = Model(model.weights.astype(np.float32), float(model.bias))
    shared = documents.sparkSession.sparkContext.broadcast(light)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "text")
    return docs.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, share double")


def residue(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, share) of the documents more than half of whose text is residue."""
    return scored(documents, model).filter(F.col("share") > RESIDUE_SHARE)
