"""Relevance of rows to prompts over several weighted fields, with the reasons for each score."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.dictionary import hot_keys, look_up
from ..plans.settle import broadcast_if_small, settle
from .ranking import RUN

#: What a field gains, times its weight: for the whole prompt, for one of its words, for a word that is part of a longer one.
PHRASE, WORD, PART = 5, 3, 1
#: A tile compares about so many values, or so many of their letters, with about so many prompts.
TILE_VALUES, TILE_LETTERS, TILE_PROMPTS = 1 << 16, 1 << 24, 1 << 15
#: Cells of a tile's table of words and rows, cells of prompts and rows scored at once, and pairs kept before only the best go on.
TABLE, BATCH, KEPT = 1 << 22, 1 << 18, 1 << 22
#: Words as T.context_tokens has them, in lower case.
_TOKEN = re.compile("[a-z0-9]{2,}")
_CAMEL = re.compile("([a-z0-9])([A-Z])")


def field_values(rows: DataFrame, within: list[str], row: str, fields: dict[str, int]) -> DataFrame:
    """within, row, field, weight, value: one row per non-blank value of each field, a string or an array of strings."""
    kinds = dict(rows.dtypes)

    def tagged(field: str, weight: int) -> Column:
        values = F.col(field) if kinds[field].startswith("array") else F.array(field)
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), F.lit(weight).alias("weight"), v.alias("value")))

    listed = [tagged(*item) for item in fields.items()]
    every = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<struct<field:string,weight:int,value:string>>")) for x in listed)))
    return rows.select(*within, row, F.inline(every)).filter(F.length(F.btrim("value")) > 0)


def field_relevance(prompts: DataFrame, values: DataFrame, within: list[str], prompt: str = "prompt_id", row: str = "row_id", most: int | None = None) -> DataFrame:
    """within, prompt, row, score, n_reasons, fields (sorted, what the score comes from) of rows that share something with a prompt.

    ``prompts``: within, an id and text; ``values`` as of ``field_values``, with positive weights. Each value that has or holds
    a word of the prompt adds its weight times PHRASE if it holds the whole prompt, and for each different word of the prompt times WORD
    if it has the word, or PART if one of its words holds it. Blank prompts match nothing. Without ``most`` all such rows come, as many as
    there are pairs; with it at least the ``most`` best rows of each prompt, the smallest first among equals, and few others.

    Rows and prompts of a group are dealt out over tiles of bounded size, each all values of some rows with some prompts. A tile adds
    values up per row and word, then scores of words per prompt, and only sends on what may be among the best: pairs of a prompt and a row are
    never shuffled.
    """
    text = F.col("value")
    odd = F.octet_length(text) != F.length(text)  # Python's lower case may differ from Spark's there
    camel = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    told = settle(values.select(*within, row, "field", "weight", "value").dropna(subset=within))
    asked = settle(prompts.select(*within, prompt, F.lower(F.btrim("text")).alias("phrase"), T.prompt_tokens("text").alias("words")).dropna(subset=within)).filter(F.size("words") > 0)
    tiles = lambda n, size: F.ceil(n / size).cast("int")
    values_of = told.groupBy(*within).agg(F.count(F.lit(1)).alias("n"), F.greatest(tiles(F.count(F.lit(1)), TILE_VALUES), tiles(F.sum(F.length("value")), TILE_LETTERS)).alias("row_tiles"))
    prompts_of = asked.groupBy(*within).agg(tiles(F.count(F.lit(1)), TILE_PROMPTS).alias("prompt_tiles"))
    sizes = settle(values_of.join(prompts_of, within))
    few = broadcast_if_small(sizes)
    hot = hot_keys(sizes, within) if few is sizes else None
    sizes = few.drop("n")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = look_up(asked, sizes, within, hot).select(*within, F.pmod(F.hash(prompt), "prompt_tiles").alias("prompt_tile"), each("row_tiles").alias("row_tile"), prompt, "phrase", "words")
    right = look_up(told, sizes, within, hot).select(*within, each("prompt_tiles").alias("prompt_tile"), F.pmod(F.hash(row), "row_tiles").alias("row_tile"), row, "field", "weight", "value", F.when(odd, F.lower(text)).alias("low"), F.when(odd, camel).alias("camel"))
    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    out = [f"`{c}` {kinds[c]}" for c in [*within, prompt, row]]
    tile = [*within, "prompt_tile", "row_tile"]

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        return _tile(a, b, within, prompt, row, most)

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(scored, ", ".join([*out, "score bigint", "n_reasons bigint", "fields string"]))


def _holders(words: Iterable[str], tokens: Iterable[str]) -> dict[str, list[str]]:
    """For each word that is in a token, or is one, all such tokens. Words have two letters or more and are looked for by their first RUN letters."""
    heads, found = defaultdict(list), defaultdict(list)
    for w in words:
        heads[w[:RUN]].append(w)
    for t in tokens:
        held = {w for i in range(len(t) - 1) for k in range(2, min(RUN, len(t) - i) + 1) for w in heads.get(t[i : i + k], ()) if t.startswith(w, i)}
        for w in held:
            found[w].append(t)
    return found


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _best(parts: list[tuple], most: int | None) -> list[tuple]:
    """Pairs (prompt, row, score, reasons, fields) as one part, by prompt, the best first; at most ``most`` of each prompt."""
    all_ = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((all_[1], -all_[2], all_[0]))
    q = all_[0][order]
    if most is not None:
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < most]
    return [tuple(x[order] for x in all_)]


def _tile(asked: pa.Table, told: pa.Table, within: list[str], prompt: str, row: str, most: int | None) -> pa.Table:
    """The scores of a tile, see ``field_relevance``."""
    kinds = [*((c, asked.schema.field(c).type) for c in [*within, prompt]), (row, told.schema.field(row).type), ("score", pa.int64()), ("n_reasons", pa.int64()), ("fields", pa.string())]
    nothing = pa.schema(kinds).empty_table()
    if not asked.num_rows or not told.num_rows:
        return nothing
    # prompts that say the same are looked at once
    different: dict[tuple, int] = {}
    which = np.array([different.setdefault((p, tuple(w)), len(different)) for p, w in zip(asked["phrase"].to_pylist(), asked["words"].to_pylist())])
    texts = list(different)
    numbers: dict[str, int] = {}
    for _, words in texts:
        for w in words:
            numbers.setdefault(w, len(numbers))

    # different values, their words and what prompts find in them
    coded = pc.dictionary_encode(told["value"].combine_chunks())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    given = coded.dictionary.to_pylist()
    lows, camels = (told[c].combine_chunks().take(pa.array(first)).to_pylist() for c in ("low", "camel"))
    lows = [v.lower() if x is None else x for v, x in zip(given, lows)]
    plain = [_TOKEN.findall(x) for x in lows]
    split = [_TOKEN.findall(_CAMEL.sub(r"\1 \2", v).lower() if x is None else x) for v, x in zip(given, camels)]
    gains: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for w, tokens in _holders(numbers, {t for x in split for t in x}).items():
        for t in tokens:
            gains[t].append((numbers[w], WORD if t == w else PART))
    found: list[dict[int, int]] = []
    for tokens in split:
        points: dict[int, int] = {}
        for t in tokens:
            for w, p in gains.get(t, ()):
                if p > points.get(w, 0):
                    points[w] = p
        found.append(points)
    n_found = np.fromiter(map(len, found), np.int64, len(found))
    if not n_found.any():
        return nothing
    word = np.fromiter((w for x in found for w in x), np.int64, n_found.sum())
    gain = np.fromiter((p for x in found for p in x.values()), np.int64, n_found.sum())
    used, word = np.unique(word, return_inverse=True)  # 0 stands for words that are nowhere
    place = np.zeros(len(numbers), np.int64)
    place[used], word = np.arange(1, len(used) + 1), word + 1

    # values that hold a whole prompt have or hold all its runs of letters
    runs = [set(_TOKEN.findall(p)) for p, _ in texts]
    held_by = _holders({r for x in runs for r in x}, {t for x in plain for t in x})
    having: dict[str, list[int]] = defaultdict(list)
    for k, tokens in enumerate(plain):
        for t in set(tokens):
            having[t].append(k)
    holding: dict[str, set[int]] = {}
    whole_q, whole_code = [], []
    for q, ((phrase, words), own) in enumerate(zip(texts, runs)):
        if all(r in held_by for r in own):
            for r in own:
                if r not in holding:
                    holding[r] = {k for t in held_by[r] for k in having[t]}
            for k in set.intersection(*sorted((holding[r] for r in own), key=len)):
                if phrase in lows[k] and any(numbers[w] in found[k] for w in words):
                    whole_q.append(q)
                    whole_code.append(k)

    # what each row gains by word, and by whole prompts; rows in their order
    ids = told[row].combine_chunks()
    rows = ids.unique()
    rows = rows.take(pc.sort_indices(rows, null_placement="at_start"))
    at = pc.index_in(ids, rows).to_numpy(zero_copy_only=False).astype(np.int64)
    names = sorted(set(told["field"].to_pylist()))
    if len(names) > 62:
        raise ValueError("at most 62 fields can be told apart")
    bit = np.left_shift(1, pc.index_in(told["field"].combine_chunks(), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64))
    weight = told["weight"].to_numpy().astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, code, weight, bit = at[order], code[order], weight[order], bit[order]
    counts = n_found[code]
    hit = _ranges((np.cumsum(n_found) - n_found)[code], counts)
    h_row, h_word, h_bit = np.repeat(at, counts), word[hit], np.repeat(bit, counts)
    h_score = np.repeat(weight, counts) * gain[hit]
    w_q, w_row, w_score, w_n, w_bit = _whole(np.array(whole_q, np.int64), np.array(whole_code, np.int64), code, at, weight, bit, len(rows))

    # prompts by their number of words that are somewhere
    lists = [sorted({int(k) for k in (place[numbers[w]] for w in words) if k}) for _, words in texts]
    turn = [q for q in sorted(range(len(texts)), key=lambda q: len(lists[q])) if lists[q]]
    size = min(len(rows), max(64, TABLE // (len(used) + 1)))
    batch = max(1, BATCH // size)
    parts: list[tuple] = []
    for r0 in range(0, len(rows), size):
        r1 = min(r0 + size, len(rows))
        n = r1 - r0
        a, b = np.searchsorted(h_row, [r0, r1])
        cell = h_word[a:b] * n + h_row[a:b] - r0
        shape = (len(used) + 1, n)
        score = np.bincount(cell, h_score[a:b], shape[0] * n).astype(np.int64).reshape(shape)
        reasons = np.bincount(cell, minlength=shape[0] * n).reshape(shape)
        marks = np.zeros(shape[0] * n, np.int64)
        np.bitwise_or.at(marks, cell, h_bit[a:b])
        marks = marks.reshape(shape)
        here = (w_row >= r0) & (w_row < r1)
        x_q, x_row, x_score, x_n, x_bit = (x[here] for x in (w_q, w_row, w_score, w_n, w_bit))
        top = int(score.sum(0).max()) + int(x_score.max(initial=0)) + 1
        kind = np.int32 if top * n < 1 << 31 else np.int64
        table = (score * n).astype(kind)  # a score and the row's place in one number: no ties
        last = np.arange(n - 1, -1, -1, dtype=kind)
        for i in range(0, len(turn), batch):
            some = np.array(turn[i : i + batch])
            wide = len(lists[some[-1]])
            words_of = np.zeros((len(some), wide), np.int64)
            for k, q in enumerate(some):
                words_of[k, : len(lists[q])] = lists[q]
            keys = np.broadcast_to(last, (len(some), n)) + table[words_of[:, 0]]
            for j in range(1, wide):
                keys += table[words_of[:, j]]
            if len(x_q):
                of = np.full(len(texts), -1)
                of[some] = np.arange(len(some))
                mine = np.flatnonzero(of[x_q] >= 0)
                keys[of[x_q[mine]], x_row[mine] - r0] += (x_score[mine] * n).astype(kind)
            least: np.ndarray | int = n
            if most is not None and n > most:
                groups = max(most, min(n, 512))
                deep = n // groups
                tops = keys[:, : groups * deep].reshape(len(some), deep, groups).max(1)
                least = np.maximum(np.partition(tops, groups - most, axis=1)[:, groups - most], n)[:, None]  # the best rows are no less than this
            k, r = np.divmod(np.flatnonzero(keys >= least), n)
            s_n, s_bit = reasons[words_of[k], r[:, None]].sum(1), np.bitwise_or.reduce(marks[words_of[k], r[:, None]], axis=1)
            if len(x_q) and len(mine):
                pair, known = some[k] * len(rows) + r + r0, x_q * len(rows) + x_row
                i_ = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                same = known[i_] == pair
                s_n, s_bit = s_n + np.where(same, x_n[i_], 0), s_bit | np.where(same, x_bit[i_], 0)
            parts.append((some[k], r + r0, (keys[k, r] // n).astype(np.int64), s_n.astype(np.int64), s_bit))
            if most is not None and sum(len(x[0]) for x in parts) > KEPT + len(texts) * most:
                parts = _best(parts, most)
    q, r, score, reasons, marks = _best(parts, most)[0]

    # to each prompt what its text has
    n_of = np.bincount(q, minlength=len(texts))
    counts = n_of[which]
    take = _ranges((np.cumsum(n_of) - n_of)[which], counts)
    own = pa.array(np.repeat(np.arange(len(which)), counts))
    told_marks, back = np.unique(marks[take], return_inverse=True)
    fields = pa.array([",".join(x for k, x in enumerate(names) if m >> k & 1) for m in told_marks.tolist()], pa.string()).take(pa.array(back))
    columns = [*(asked[c].combine_chunks().take(own) for c in [*within, prompt]), rows.take(pa.array(r[take])), pa.array(score[take]), pa.array(reasons[take]), fields]
    return pa.Table.from_arrays(columns, schema=pa.schema(kinds))


def _whole(q: np.ndarray, held: np.ndarray, code: np.ndarray, at: np.ndarray, weight: np.ndarray, bit: np.ndarray, n_rows: int) -> tuple[np.ndarray, ...]:
    """prompt, row, score, reasons, fields of the rows whose values hold a whole prompt, by prompt and row; ``held``: the value's code, for each pair with ``q``."""
    order = np.argsort(code, kind="stable")
    a, b = np.searchsorted(code[order], held), np.searchsorted(code[order], held, "right")
    entry = order[_ranges(a, b - a)]
    pair, back = np.unique(np.repeat(q, b - a) * n_rows + at[entry], return_inverse=True)
    marks = np.zeros(len(pair), np.int64)
    np.bitwise_or.at(marks, back, bit[entry])
    score = np.bincount(back, weight[entry] * PHRASE, len(pair)).astype(np.int64)
    return pair // n_rows, pair % n_rows, score, np.bincount(back, minlength=len(pair)), marks
