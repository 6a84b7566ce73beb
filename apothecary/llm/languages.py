"""Language of documents and of their stretches, by compression.

Each language has a zstandard raw-content dictionary of sample sentences. A sentence
belongs to the language whose dictionary packs it smallest; neighbouring sentences of a
few words are packed together. Over a text the cheapest sequence of languages is chosen,
where a change of language costs a fixed number of bytes; a sentence with a narrow margin
decides nothing and joins its neighbours. Where all margins are narrow the sentences
decide together, and the text is rejected if even their sum is narrow.

The dictionaries are fitted on a bounded sample of labelled documents
(``SAMPLE_DOCS`` a language, chosen by hash); labels may be wrong, so sentences that
word counts assign to another language are first left out of the sample. All
dictionaries are cut to the length of the shortest (8,000 bytes at least), so that none
packs better by size alone. All documents are then classified, whole.

Defined cases: NULL, blank and code-only texts give no rows; a rejected text has one
stretch with a NULL language; a label no spelling of a language counts as missing;
documents without id are left out of the sample; without any labelled documents there
are no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 400
DICTIONARY_BYTES = 64_000
#: Bytes that a change of language costs; and the lead below which a sentence decides nothing.
SWITCH = 10
MARGIN = 3
LEVEL = 1
#: Words that a sentence needs to stand for itself, and a whole text to be more than codes.
LEAST_WORDS, LEAST_TEXT = 5, 2

# Spellings of each language in labels.
NAMES = {
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "pt": ("pt", "por", "portuguese", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names}
#: After closing punctuation, or at an empty line; other line ends may stand within a sentence.
_BREAK = re.compile(r"([.!?…。])[\"'”’»)\]]*\s+|\n\s*\n\s*|\r\s*\r\s*")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_MARKS = re.compile(r"[\u0300-\u036f]+")
_DIGIT = re.compile(r"\d")


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))


def label_code(label: str | None) -> str | None:
    """The language a label names, in any spelling; None if it names none of them."""
    head = re.split(r"[-_]", fold((label or "").strip()))[0].strip()
    return _BY_NAME.get(head)


def _plain(part: str) -> str:
    """Words of a sentence that hold no digit."""
    ws = part.split()
    return " ".join([w for w in ws if not _DIGIT.search(w)] if _DIGIT.search(part) else ws)


def sentences(text: str) -> list[str]:
    """Sentences of a text, folded, without words that hold digits."""
    text, start, parts = fold(text), 0, []
    for m in _BREAK.finditer(text):
        parts.append(text[start : m.end(1) if m[1] else m.start()])
        start = m.end()
    return [s for p in [*parts, text[start:]] if (s := _plain(p))]


def n_words(sentence: str, enough: int = 1 << 30) -> int:
    """Words with two letters in a row, counted up to ``enough``."""
    n = 0
    for w in sentence.split():
        if w[:2].isalpha() and len(w) > 1 or _LETTERS.search(w):
            n += 1
            if n >= enough:
                break
    return n


def telling(sentence: str) -> bool:
    return n_words(sentence, LEAST_WORDS) >= LEAST_WORDS


def units(text: str) -> list[str]:
    """What is packed at a time: each sentence of ``LEAST_WORDS``, and each run of shorter ones with as many together.

    Shorter runs between longer sentences decide nothing. A text without any longer
    sentence is one unit, if it is more than codes.
    """
    out, run = [], []
    parts = sentences(text)
    for s in [*parts, None]:
        if s is not None and not telling(s):
            run.append(s)
            continue
        if run and telling(" ".join(run)):
            out.append(" ".join(run))
        run = []
        if s is not None:
            out.append(s)
    whole = " ".join(parts)
    return out or ([whole] if n_words(whole) >= LEAST_TEXT else [])


def fit(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    """Raw dictionary content a language from (language, text) pairs with some wrong labels."""
    seen: dict[str, Counter] = {}
    rows = []
    for lang, text in sample:
        for s in sentences(text):
            if telling(s):
                ws = _LETTERS.findall(s)
                rows.append((lang, s, ws))
                seen.setdefault(lang, Counter()).update(set(ws))
    if not seen:
        return {}
    total = {k: sum(c.values()) for k, c in seen.items()}
    rate = lambda lang, w: math.log((seen[lang][w] + 0.02) / (total[lang] + 1))
    kept: dict[str, dict[str, None]] = {k: {} for k in seen}
    for lang, s, ws in rows:
        if max(seen, key=lambda k: (sum(rate(k, w) for w in ws), k)) == lang:
            kept[lang][s] = None
    out = {}
    for lang, texts in kept.items():
        # Sentences that bring new words come last, where matches are cheapest to reach.
        known, new, rest = set(), [], []
        for s in texts:
            ws = set(_LETTERS.findall(s))
            (new if len(ws - known) >= 2 else rest).append(s)
            known |= ws
        body = "\n".join(new).encode()[:DICTIONARY_BYTES]
        room = DICTIONARY_BYTES - len(body)
        out[lang] = "\n".join(rest).encode()[: max(0, room)] + b"\n" + body
    return out


def balance(dictionaries: dict[str, bytes]) -> dict[str, bytes]:
    """Dictionaries of one length, so that none packs better by size alone."""
    least = max(8_000, min(map(len, dictionaries.values()), default=0))
    return {k: v[-least:] for k, v in dictionaries.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        self.packers = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, sentence: str) -> list[int]:
        raw = sentence.encode()
        return [len(p.compress(raw)) for p in self.packers]

    def stretches(self, text: str) -> list[tuple[str | None, float]]:
        """(language, confidence) of each maximal stretch; the language is None where margins are too narrow."""
        costs = [self.sizes(s) for s in units(text)]
        if not costs:
            return []
        n = len(self.langs)
        margin = lambda c: sorted(c)[1] - min(c) if n > 1 else MARGIN
        firm = [c for c in costs if margin(c) >= MARGIN]
        if not firm:
            firm = [[sum(c[k] for c in costs) for k in range(n)]]
            if margin(firm[0]) < MARGIN:
                return [(None, 0.5)]
        first = firm[0].index(min(firm[0]))
        if all(c[first] == min(c) for c in firm):
            # No other language is cheaper anywhere, so no sequence can be.
            return [(self.langs[first], self._sure(sum(margin(c) for c in firm)))]
        best, back = list(firm[0]), []
        for c in firm[1:]:
            low = min(range(n), key=lambda k: (best[k], k))
            back.append([k if best[k] <= best[low] + SWITCH else low for k in range(n)])
            best = [min(best[k], best[low] + SWITCH) + c[k] for k in range(n)]
        path = [min(range(n), key=lambda k: (best[k], k))]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        out: list[list] = []
        for k, c in zip(path, firm):
            lead = min((x for i, x in enumerate(c) if i != k), default=c[k] + MARGIN) - c[k]
            if out and out[-1][0] == k:
                out[-1][1] += lead
            else:
                out.append([k, lead])
        return [(self.langs[k], self._sure(lead)) for k, lead in out]

    @staticmethod
    def _sure(lead: float) -> float:
        """A lead of some ten bytes is near certain; the value grows with the lead and stays in 0.5 to 1."""
        return round(1 / (1 + math.exp(-lead / 4)), 4)


def training_sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most ``most`` labelled documents a language, by hash of their id: a bounded sample, not all rows.

    The documents of a language are counted first, so that a bound on the hash leaves about
    three times as many as are wanted; only those are ranked.
    """
    names = F.create_map(*[F.lit(x) for kv in _BY_NAME.items() for x in kv])
    head = F.lower(F.trim(F.translate(F.split(F.col("lang"), "[-_]")[0], "áàãâéêíóôõúçñÁÀÃÂÉÊÍÓÔÕÚÇÑ", "aaaaeeiooouncAAAAEEIOOOUCN")))
    head = F.regexp_replace(F.regexp_replace(head, "espa.ol", "espanol"), "fran.ais", "francais")
    rows = docs.where(F.length("text").between(40, 20_000) & F.col("doc_id").isNotNull()).select(F.element_at(names, head).alias("code"), "text", F.xxhash64("doc_id").alias("at")).where(F.col("code").isNotNull())
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    top = {code: int(-(2**63) + min(1.0, 3 * most / n) * (2**64 - 1)) for code, n in counts.items()}
    within = F.col("at") <= F.element_at(F.create_map(*[F.lit(x) for code, v in top.items() for x in (code, min(v, 2**63 - 1))]), F.col("code"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("at", "text"))
    chosen = rows.where(within).withColumn("rank", rank).where(F.col("rank") <= most)
    return sorted((r["code"], r["text"]) for r in chosen.select("code", "text").collect())


def classify(docs: DataFrame, dictionaries: dict[str, bytes], every: bool = True) -> DataFrame:
    """doc_id, seg, lang, confidence, label of every stretch; without ``every`` only of documents whose
    label is missing or wrong and of those in several languages. Each document is whole in one task, so
    what is not wanted never leaves it."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value) if shared.value else None
        for b in batches:
            rows = []
            for doc, text, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if model and text.is_valid:
                    code, found = label_code(label), model.stretches(text.as_py())
                    if every or len(found) > 1 or (found and (code is None or found[0][0] != code)):
                        rows += [(doc, i, lang, sure, code) for i, (lang, sure) in enumerate(found, 1)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
            names = ["doc_id", "seg", "lang", "confidence", "label"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, seg bigint, lang string, confidence double, label string")


def find(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, seg, lang, confidence of the stretches of documents whose label is missing or wrong, and of
    all documents in several languages; rejected texts have a NULL language."""
    model = balance(fit(training_sample(docs, most)))
    return classify(docs, model, every=False).select("doc_id", "seg", "lang", "confidence")
