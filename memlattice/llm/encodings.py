"""Text that was decoded with the wrong character encoding: finding it and restoring it.

Method: a multinomial classifier on hashed byte bigrams is trained on passages of the corpus itself and on the same
passages garbled synthetically through every known chain of encodings. It predicts the chain of each passage; the chain
is inverted, and the result stands only if every step decodes strictly and the classifier takes the outcome for sound.

A passage is a word: a run of characters without blanks that holds a character beyond ASCII.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settle import discard, settle

# The chains, each a list of steps (true encoding, encoding it was read with); '!' marks chains that lose characters.
SINGLE_READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2", "iso8859-5", "iso8859-15", "cp932", "gbk")
OTHER_PAIRS = (
    "cp1252>cp1251", "cp1252>cp1250", "cp1252>cp1253", "cp1252>cp437", "cp1252>cp850", "cp1252>mac_roman", "cp1252>koi8-r", "cp1252>cp866",
    "cp437>cp1252", "cp850>cp1252", "mac_roman>cp1252", "cp1250>cp1252", "cp1250>cp1251", "iso8859-2>cp1252", "cp852>cp1252", "cp852>cp1250",
    "cp1251>cp1252", "cp1251>mac_roman", "cp1251>koi8-r", "cp1251>cp866", "koi8-r>cp1251", "koi8-r>cp1252", "cp866>cp1251", "cp866>cp1252", "iso8859-5>cp1252", "iso8859-5>cp1251",
    "cp1254>cp1252", "cp1254>cp1251", "cp1254>cp1250", "cp857>cp1252", "cp932>cp1252", "cp932>latin-1", "cp932>mac_roman", "cp932>cp437", "euc_jp>cp1252", "euc_jp>latin-1",
)
TWICE = ("utf-8>cp1252>utf-8>cp1252", "utf-8>latin-1>utf-8>latin-1", "utf-8>cp1252>utf-8>latin-1", "utf-8>latin-1>utf-8>cp1252", "utf-8>cp1252>utf-8>cp1252>utf-8>cp1252")
LOSSY = ("cp1252>utf-8!", "cp1250>utf-8!", "cp1251>utf-8!", "cp1254>utf-8!", "cp932>utf-8!")
CHAINS = (*(f"utf-8>{w}" for w in SINGLE_READERS), *TWICE, *OTHER_PAIRS, *LOSSY)
#: Words are told apart by the script of their first letter beyond ASCII, else the shares of one script would dilute another's.
SCRIPTS = ("latin", "cyrillic", "cjk", "other", "marks")
N_LABELS = (len(CHAINS) + 1) * len(SCRIPTS)

#: Hash buckets of byte bigrams.
BUCKETS = 1 << 14
#: The classifier is fitted on the words of about this many documents, drawn by a hash of doc_id.
TRAINING_DOCUMENTS = 20_000
#: Added to each count.
SMOOTHING = 0.05
#: The log prior of a sound passage over one of a given chain.
SOUND_PRIOR = 6.0
#: By so much the log weight of the restored passage as a sound one must beat that of the passage found.
GAIN = 4.0
#: A chain of one-byte encodings decodes anything, so it is believed only on passages of at least this many characters.
LEAST_LENGTH = 2
#: A passage that no chain restores is garbled all the same if the log weight of a chain beats that of a sound passage by this.
CERTAIN = 25.0
#: Categories of characters that no restored passage has: controls, surrogates and unassigned ones; blanks and format characters may be.
UNLIKELY = ("Cc", "Cs", "Cn")
#: Passages whose result a worker keeps.
KEPT = 100_000

#: Characters per piece of a training word.
PIECE = 400

WORDS = re.compile(r"[^ \t\n\r\f\v]+")
QUOTED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)


@functools.cache
def _table(name: str) -> tuple[str, dict[str, int]]:
    """The characters of the 256 bytes of a one-byte encoding and back; undefined bytes are read as the control characters of their number, as readers do."""
    letters = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))
    return letters, {c: b for b, c in reversed(list(enumerate(letters)))}


def _is_one_byte(name: str) -> bool:
    return codecs.lookup(name).name not in ("utf-8", "cp932", "gbk", "euc_jp")


def steps_of(chain: str) -> list[tuple[str, str]]:
    names = chain.rstrip("!").split(">")
    return list(zip(names[::2], names[1::2]))


def garble(text: str, chain: str) -> str | None:
    """The text as the chain leaves it; None if an encoding lacks a character of it."""
    for true, wrong in steps_of(chain):
        try:
            raw = text.encode(true)
        except UnicodeEncodeError:
            return None
        text = raw.decode("latin-1").translate(_translation(wrong)) if _is_one_byte(wrong) else raw.decode(wrong, "replace")
    return text


@functools.cache
def _translation(name: str) -> dict[int, str]:
    return dict(enumerate(_table(name)[0]))


def _bytes_again(text: str, wrong: str) -> bytes | None:
    if not _is_one_byte(wrong):
        try:
            return text.encode(wrong)
        except UnicodeEncodeError:
            return None
    back = _table(wrong)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def ungarble(text: str, chain: str) -> str | None:
    """The text before the chain; None unless every step is decoded strictly."""
    if chain.endswith("!"):
        return None
    for true, wrong in reversed(steps_of(chain)):
        raw = _bytes_again(text, wrong)
        if raw is None:
            return None
        try:
            text = raw.decode(true)
        except UnicodeDecodeError:
            return None
    return text


#: A whole UTF-8 sequence of two to four bytes.
SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def holds_sequence(text: str, chain: str) -> bool:
    """Whether some part of the text, read back through the chain's last step, is a UTF-8 sequence of more than one byte."""
    true, wrong = steps_of(chain)[-1]
    if true != "utf-8" or not _is_one_byte(wrong):
        return False
    back = _table(wrong)[1]
    for match in SEQUENCE.finditer(bytes(back.get(c, 0x20) for c in text)):
        try:
            match.group().decode("utf-8")
            return True
        except UnicodeDecodeError:
            pass
    return False


def bigrams(word: str) -> np.ndarray:
    """Hash buckets of the byte bigrams of a passage, with a blank on both sides, that hold a byte beyond ASCII."""
    raw = np.frombuffer(b" " + word.encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.int64)
    a, b = raw[:-1], raw[1:]
    touched = (a > 127) | (b > 127)
    code = a[touched] * 256 + b[touched]
    return (code * 2654435761 >> 7) % BUCKETS


def passages(text: str) -> list[str]:
    """The words with characters beyond ASCII, without what stands between backticks."""
    if text.isascii():
        return []
    return [w for w in WORDS.findall(QUOTED.sub(" ", text) if "`" in text else text) if not w.isascii()]


def script_of(word: str) -> int:
    """The index in SCRIPTS of the first letter beyond ASCII; words whose only such characters are no letters are marks."""
    for c in word:
        if c > "\x7f" and c.isalpha():
            n = ord(c)
            return 0 if n < 0x250 or 0x1E00 <= n < 0x1F00 else 1 if 0x400 <= n < 0x530 else 2 if 0x3040 <= n < 0xA000 or n >= 0x20000 else 3
    return 4


def _looks_garbled(word: str) -> bool:
    """Whether strict reversal of a common chain shows that a training passage is itself garbled."""
    if "�" in word:
        return True
    return any((back := ungarble(word, f"utf-8>{w}")) is not None and back != word for w in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250"))


def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words): of each document with passages a hash of them in their order, and the different ones; words longer than PIECE count piece by piece."""
    for batch in batches:
        told = {}
        for text in batch.column(0).to_pylist():
            if text and (found := passages(text)):
                told[hashlib.md5("\n".join(found).encode("utf-8", "surrogatepass")).digest()] = sorted({piece for w in found for at in range(0, len(w), PIECE) if not (piece := w[at : at + PIECE]).isascii()})
        yield pa.RecordBatch.from_arrays([pa.array(told.keys(), pa.binary()), pa.array(told.values(), pa.list_(pa.string()))], ["key", "words"])


def _count(counts: np.ndarray, word: str, n: int) -> None:
    """Adds to counts (labels x buckets x 2) the bigrams of a word by its script, once and n times, as it is (the first labels) and through each chain."""
    script = script_of(word)
    np.add.at(counts[script], bigrams(word), (1, n))
    for k, chain in enumerate(CHAINS, 1):
        broken = garble(word, chain)
        if broken is not None and broken != word:
            np.add.at(counts[k * len(SCRIPTS) + script], bigrams(broken), (1, n))


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, bucket, once, n): bigram counts of the words that no common chain shows to be garbled, each word counted once and as often as texts have it."""
    counts = np.zeros((N_LABELS, BUCKETS, 2), np.int64)
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not _looks_garbled(word):
                _count(counts, word, n)
    label, bucket = np.nonzero(counts[:, :, 0])
    yield pa.RecordBatch.from_arrays([pa.array(label.astype("int32")), pa.array(bucket.astype("int32")), *map(pa.array, counts[label, bucket].T)], ["label", "bucket", "once", "n"])


def _log_weights(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTHING
    return np.log(smooth / smooth.sum(axis=-1, keepdims=True)).astype(np.float32)


def _second_looks(batches: Iterator[pa.RecordBatch], once: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n, back): the words that the classifier of these counts, held out from the word itself, restores to another one."""
    restorer = Restorer(_log_weights(once))
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if _looks_garbled(word):
                continue
            script = script_of(word)
            kept, others = restorer.weights[script].copy(), once[script].copy()
            np.subtract.at(others, bigrams(word), 1)
            restorer.weights[script] = _log_weights(others)
            hit = restorer._judge(word)
            restorer.weights[script] = kept
            if hit and hit[1] != word:
                rows.append((word, n, hit[1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, (pa.string(), pa.int64(), pa.string()))], ["word", "n", "back"])


def _collected(counted: DataFrame) -> np.ndarray:
    """Counts N_LABELS x BUCKETS x 2: once and n."""
    sums = counted.groupBy("label", "bucket").agg(F.sum("once").alias("once"), F.sum("n").alias("n")).toPandas()
    counts = np.zeros((N_LABELS, BUCKETS, 2), np.int64)
    counts[sums["label"].to_numpy(), sums["bucket"].to_numpy()] = sums[["once", "n"]].to_numpy()
    return counts


def train(documents: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> np.ndarray:
    """Log weights N_LABELS x BUCKETS (float32) of a multinomial naive Bayes classifier.

    Documents with the same passages count once. Of a first fit, which counts each different word once, each word is taken out
    and judged: one that is restored to a word of more documents is garbled and no training word. The driver gets at most two
    numbers per label and bucket of each fit, whatever the corpus; one without passages gives equal weights.
    """
    share = min(1.0, training_documents / max(1, documents.count()))
    drawn = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))) if share < 1 else documents
    context = documents.sparkSession.sparkContext
    texts = drawn.select("text").mapInArrow(_training_words, "key binary, words array<string>").dropDuplicates(["key"])
    words = settle(texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).repartition(context.defaultParallelism))
    schema = "label int, bucket int, once bigint, n bigint"
    counts = _collected(words.mapInArrow(_training_counts, schema))
    shared = context.broadcast(counts[:, :, 0])
    looked = words.mapInArrow(lambda batches: _second_looks(batches, shared.value), "word string, n bigint, back string")
    garbled = looked.join(words.select(F.col("word").alias("back"), F.col("n").alias("n_back")), "back").filter("n_back > n").select("word", "n")
    counts -= _collected(garbled.mapInArrow(_training_counts, schema))
    shared.unpersist()
    discard(words)
    return _log_weights(counts[:, :, 1])


class Restorer:
    """The classifier with its inversion and checks; results of known passages are kept."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, tuple[str, str] | None] = {}

    def scores(self, word: str) -> np.ndarray:
        """Of sound and of each chain, the best script of each."""
        found = bigrams(word)
        if len(found) > PIECE:
            kinds, n = np.unique(found, return_counts=True)
            sums = self.weights[:, kinds] @ n
        else:
            sums = self.weights[:, found].sum(axis=1)
        out = sums.reshape(-1, len(SCRIPTS)).max(axis=1)
        out[0] += SOUND_PRIOR
        return out

    def judge(self, word: str) -> tuple[str, str] | None:
        """None for a sound passage, else (chain, restored passage); the passage itself where it can't be restored."""
        if word in self.known:
            return self.known[word]
        hit = self._judge(word)
        if len(word) <= PIECE:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[word] = hit
        return hit

    def _judge(self, word: str) -> tuple[str, str] | None:
        scores = self.scores(word)
        likely = [int(k) for k in np.argsort(-scores) if k and scores[k] > scores[0]]
        if not likely:
            return None
        for k in likely:
            back = ungarble(word, CHAINS[k - 1])
            if back is not None and back != word and not any(unicodedata.category(c) in UNLIKELY for c in back) and (CHAINS[k - 1].startswith("utf-8") or len(word) >= LEAST_LENGTH):
                after = self.scores(back)
                if after[0] >= after.max() and after[0] > scores[0] + GAIN:
                    return CHAINS[k - 1], back
        for k in likely:
            if CHAINS[k - 1].endswith("!") and "�" in word or holds_sequence(word, CHAINS[k - 1]):
                return CHAINS[k - 1], word
        if scores[likely[0]] - scores[0] > CERTAIN:
            return CHAINS[likely[0] - 1], word
        return None


def restore(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, chain (the most frequent of its passages), n_garbled, n_restored, text (restored where possible) of the documents
    with at least one garbled passage. Passages between backticks are left as they are. Null, empty and plain texts are sound."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {w: hit for w in set(passages(text)) if (hit := restorer.judge(w))} if text else None
                if not found:
                    continue
                chains: Counter[str] = Counter()
                done = 0

                def mend(match: re.Match) -> str:
                    nonlocal done
                    hit = found.get(match.group())
                    if not hit:
                        return match.group()
                    chains[hit[0]] += 1
                    done += hit[1] != match.group()
                    return hit[1]

                quoted = [m.span() for m in QUOTED.finditer(text)]
                parts, at = [], 0
                for a, b in [*quoted, (len(text), len(text))]:
                    parts += [WORDS.sub(mend, text[at:a]), text[a:b]]
                    at = b
                if chains:
                    rows.append((key, min(chains, key=lambda c: (-chains[c], c)), sum(chains.values()), done, "".join(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "chain", "n_garbled", "n_restored", "text"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chain string, n_garbled int, n_restored int, text string")


def repaired(documents: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """The garbled documents of ``documents`` as of ``restore``, by a classifier trained on them."""
    return restore(documents, train(documents.select("doc_id", "text"), training_documents))
