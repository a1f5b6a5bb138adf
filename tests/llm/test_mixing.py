import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memlattice.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def by_quotients(shares, caps, blocks):
    quotas = [0] * len(shares)
    for _ in range(blocks):
        free = [i for i, s in enumerate(shares) if s > 0 and (caps[i] is None or quotas[i] < caps[i])]
        if not free:
            break
        quotas[max(free, key=lambda i: (shares[i] / sum(s for s in shares if s > 0) / (2 * quotas[i] + 1), -i))] += 1
    return quotas


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.one_of(st.none(), st.integers(0, 30))), min_size=1, max_size=7), st.integers(0, 90))
def test_apportionment_is_by_highest_quotients(parties, blocks):
    shares, caps = [s / 100 for s, _ in parties], [c for _, c in parties]
    got, want = M.apportion(shares, caps, blocks), by_quotients(shares, caps, blocks)
    assert sum(got) == sum(want)
    assert sorted(zip(shares, caps, got), key=str) == sorted(zip(shares, caps, want), key=str) or max(abs(a - b) for a, b in zip(got, want)) <= 1


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3), st.integers(0, 2047), st.data())
def test_shard_quotas_add_up(shards, tail, data):
    n = shards * M.SHARD_BLOCKS + tail
    blocks = data.draw(st.integers(0, n))
    each, more, last, full = M._shard_quotas(blocks, shards, tail)
    assert each * full + more + last == blocks and full == shards and last <= tail and each + (more > 0) <= M.SHARD_BLOCKS


def mixed(spark, docs, targets, **options):
    rows = [(i, t, s, "clash") for i, (t, s) in enumerate(docs)]
    copies, shares = M.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS), block_tokens=16, **options)
    return {r.doc_id: r for r in copies.collect()}, {r.source: r for r in shares.collect()}


def test_shares_repeats_and_spellings(spark):
    docs = [(f"word {i} and some more text of about ten tokens", s) for i in range(400) for s in (["Big Source", " big_source ", "BIG-SOURCE"][i % 3],)]
    docs += [(f"small {i} with a text of about ten tokens here", "small") for i in range(40)] + [(None, "small"), ("", "small"), ("x " * 3000, "long"), ("y", "unknown"), ("z", None)]
    targets = [("big-source", 0.5, 1), ("small", 0.3, 2), ("long", 0.2, 1), ("absent", 0.4, 3), ("shareless", None, 1)]
    copies, shares = mixed(spark, docs, targets)
    assert set(copies) == set(range(len(docs) - 2))
    assert all(r.copies <= {"big-source": 1, "small": 2, "long": 1}[r.source] for r in copies.values())
    assert shares["small"].most_copies == 2 and shares["small"].mixed_tokens == 2 * shares["small"].source_tokens  # its cap is below its share
    assert shares["absent"].mixed_tokens == shares["shareless"].mixed_tokens == 0
    assert abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-9
    again, _ = mixed(spark, docs, targets)
    assert {k: r.copies for k, r in again.items()} == {k: r.copies for k, r in copies.items()}


def test_targets_are_met_when_no_cap_binds(spark):
    docs = [(f"text {i} of a few tokens", "ab"[i % 2]) for i in range(600)]
    copies, shares = mixed(spark, docs, [("a", 0.8, 5), ("b", 0.2, 5)])
    assert abs(shares["a"].reached_share - 0.8) < 0.01
    other, _ = mixed(spark, docs, [("a", 0.8, 5), ("b", 0.2, 5)], seed=99)
    assert {k: r.copies for k, r in other.items()} != {k: r.copies for k, r in copies.items()}
    total = sum(r.n_tokens for r in copies.values())
    assert abs(sum(r.n_tokens * r.copies for r in copies.values()) - total) < 0.02 * total


def test_buckets_do_not_change_the_order_of_tokens(spark, monkeypatch):
    docs = [(f"text {i} " * (i % 7), "a") for i in range(300)]
    targets = [("a", 1.0, 1)]
    whole, _ = mixed(spark, docs, targets)
    monkeypatch.setattr(M, "BUCKET_DOCUMENTS", 10)
    split, shares = mixed(spark, docs, targets)
    assert {k: r.copies for k, r in split.items()} == {k: r.copies for k, r in whole.items()} and shares["a"].most_copies == 1


def test_quotas_are_met_in_spite_of_long_documents(spark):
    """A third of the tokens of each source are in a few long documents; no cap binds."""
    docs = [(f"word {i} " * (600 if i % 40 == 0 else 1 + i % 20), "ab"[i % 2]) for i in range(900)]
    for seed in (1, 2, 3):
        copies, shares = mixed(spark, docs, [("a", 0.83, 9), ("b", 0.17, 9)], seed=seed)
        for r in shares.values():
            assert abs(r.mixed_tokens - r.quota_blocks * 16) <= 0.005 * r.mixed_tokens and r.most_copies <= 9
        assert min(r.copies for r in copies.values()) >= 0


@pytest.mark.parametrize("docs, targets", [([], [("a", 1.0, 1)]), ([("x", "a")], []), ([(None, "a")], [("a", 1.0, None)])])
def test_empty(spark, docs, targets):
    copies, shares = mixed(spark, docs, targets)
    assert sum(r.n_tokens * r.copies for r in copies.values()) == 0 and all(not r.mixed_tokens for r in shares.values())
