import random

import numpy as np
import pytest

from memlattice.llm import encodings as G

SOUND = [
    "Größe und Länge der Datei wurden nachträglich geändert.", "L’équipe préfère garder l’ancien module jusqu’à la prochaine étape.", "Según el informe, 932 referencias quedaron huérfanas.",
    "Należy usunąć nieużywane wpisy przed następną próbą.", "ATENÇÃO: A MEMÓRIA GERADA NÃO DEVE SER EDITADA À MÃO.", "Каждое изменение должно иметь краткое объяснение.", "次の実行でこの報告は上書きされます。",
    "Değişiklik kapsam dışında kaldığı için görev durduruldu.", "“src/app.ts” — that’s the file nobody wants to own…", "Price: £5 or €7, © team; ± 3 µs at 21 °C", "Ελληνικά: ο κόμβος δεν έχει ιδιοκτήτη.", "├── src │ ⚠ late 🚀",
]
CHAINS = ("utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp1251", "utf-8>cp1252>utf-8>cp1252")
DOCS = "doc_id bigint, text string, chain string"


@pytest.mark.parametrize("chain", [c for c in G.CHAINS if not c.endswith("!")])
def test_chains_are_undone(chain):
    for text in SOUND:
        broken = G.garble(text, chain)
        if broken is not None and "�" not in broken:
            back = G.ungarble(broken, chain)
            assert back in (text, None)
            assert back == text or len(set(broken)) < len(set(text)) or chain.split(">")[1] not in ("cp1252", "latin-1")


def corpus(seed=0, n=600):
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        parts = [f"Plain words {i}.", *r.sample(SOUND, 3)]
        if i % 6 == 0:
            k = r.randrange(1, 4)
            chain = r.choice(CHAINS)
            broken = G.garble(parts[k], chain)
            if broken not in (None, parts[k]) and k:
                truth[i] = " ".join(parts)
                parts[k] = broken
        rows.append((i, " ".join(parts), "clash"))
    return rows, truth


def test_found_and_restored_on_held_out_documents(spark):
    weights = G.train(spark.createDataFrame(corpus(1)[0], DOCS))
    rows, truth = corpus(2)
    got = {r.doc_id: r for r in G.restore(spark.createDataFrame(rows, DOCS), weights).collect()}
    assert len(got.keys() & truth.keys()) >= 0.95 * len(truth) and len(got.keys() - truth.keys()) <= 2
    whole = [k for k in got.keys() & truth.keys() if got[k].text == truth[k]]
    assert len(whole) >= 0.8 * len(truth)


def test_many_copies_of_one_garbled_document(spark):
    """A third of the rows are copies of a text garbled by a chain that no quick reversal shows; only their ASCII parts differ."""
    sound = SOUND[5] + " Объём работы ограничен файлами."
    rows = [(i, text + (" " + sound if i % 6 == 1 else ""), c) for i, text, c in corpus(1)[0] if not any(w in text for w in ("Ð", "╨"))]
    copies = [(10_000 + i, f"Copy {i}. " + G.garble(sound, "cp1251>cp1252"), "") for i in range(len(rows) // 2)]
    got = {r.doc_id: r for r in G.repaired(spark.createDataFrame(rows + copies, DOCS)).collect()}
    assert [k for k, _, _ in copies if k not in got] == []
    assert got[10_000].text == f"Copy 0. {sound}"


@pytest.mark.parametrize("blank", ["\u00a0", "\u3000", "\u202f", "\u00ad", "\u200b"])
def test_blanks_and_format_characters_are_restored(blank):
    sound, broken = f"é{blank}é", G.garble(f"é{blank}é", "utf-8>cp1252")
    counts = np.full((G.N_LABELS, G.BUCKETS), G.SMOOTHING)
    np.add.at(counts[0], G.bigrams(sound), 1000)
    np.add.at(counts[len(G.SCRIPTS) * (G.CHAINS.index("utf-8>cp1252") + 1)], G.bigrams(broken), 1000)
    assert G.Restorer(np.log(counts / counts.sum(axis=1, keepdims=True))).judge(broken) == ("utf-8>cp1252", sound)


def test_backticks_lost_characters_and_nothing(spark):
    weights = G.train(spark.createDataFrame(corpus(1)[0], DOCS))
    rows = [(1, "Sample cell: `GrÃ¶ÃŸe`. The reader prints “Größe”.", ""), (2, "Die Pr�fung und die L�nge der Datei", ""), (3, None, ""), (4, "", ""), (5, "plain", ""), (6, "x GrÃ¶ÃŸe `GrÃ¶ÃŸe` " + "a " * 50_000, ""), (7, "```\nGrÃ¶ÃŸe\n```", "")]
    got = {r.doc_id: r for r in G.restore(spark.createDataFrame(rows, DOCS), weights).collect()}
    assert set(got) == {2, 6}
    assert got[2].n_restored == 0 and got[2].text == rows[1][1]
    assert got[6].text.startswith("x Größe `GrÃ¶ÃŸe` a ")


def test_empty_corpus(spark):
    assert G.repaired(spark.createDataFrame([], DOCS)).count() == 0
    assert G.repaired(spark.createDataFrame([(1, "plain", ""), (2, None, "")], DOCS)).count() == 0


def test_long_runs_take_linear_time():
    import time

    weights = np.zeros((G.N_LABELS, G.BUCKETS), np.float32)
    restorer = G.Restorer(weights)
    for run in ("x" * 1_000_000 + " é", "é" + "x" * 1_000_000, "я" * 1_000_000):
        began = time.perf_counter()
        words = G.passages(run)
        assert time.perf_counter() - began < 1
        assert words == [w for w in run.split() if not w.isascii()]
        restorer.scores(words[0])
        assert time.perf_counter() - began < 2


@pytest.mark.parametrize("chain", ["cp1251>cp1252", "utf-8>cp932", "utf-8>gbk"])
def test_damaged_passages_are_found_by_any_chain(chain):
    """What no chain restores is still found where the classifier is certain."""
    sound = "объединение"
    broken = G.garble(sound, chain)
    damaged = broken[:3] + "語" + broken[3:-1]  # no chain inverts it
    counts = np.full((G.N_LABELS, G.BUCKETS), G.SMOOTHING)
    np.add.at(counts[1], G.bigrams(sound), 1000)
    np.add.at(counts[len(G.SCRIPTS) * (G.CHAINS.index(chain) + 1)], G.bigrams(broken), 1000)
    restorer = G.Restorer(np.log(counts / counts.sum(axis=1, keepdims=True)))
    assert restorer.judge(damaged) == (chain, damaged) and restorer.judge(sound) is None


def test_long_training_words_count_piece_by_piece():
    import pyarrow as pa

    word = "é" * 450 + "x" * 500 + "ü"
    rows = list(G._training_words(iter([pa.RecordBatch.from_arrays([pa.array([word])], ["text"])])))[0].to_pylist()
    assert rows[0]["words"] == sorted(["é" * 400, "é" * 50 + "x" * 350, "x" * 150 + "ü"])
