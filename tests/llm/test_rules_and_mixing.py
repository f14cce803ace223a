from collections import Counter, defaultdict
from fractions import Fraction

import corpora
from loomset.llm import mixing, quality_rules as qr
from pyspark.sql import functions as F


def measures(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def base_failed(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def test_measures_and_verdicts(rows):
    data = corpora.documents(6) + [(7000 + i, "bad", "bad host") for i in range(80)] + [(7100, corpora.documents(6)[20][1] * 3, "bad host")]
    data += [(7200, "a\nb\na\n \n \na \nb" + " w" * 60, "src0"), (7201, "é\x85\xa0x " * 60, "src0")]
    got = qr.judge(corpora.frame(rows, data)).collect()
    want = Counter((i, s, *measures(t), base_failed(measures(t))) for i, t, s in data)
    assert Counter((r.doc_id, r.host, *[r[m] for m in qr.MEASURES], r.base_failed) for r in got) == want
    rates = {r.host: r.host_rate for r in got}
    fails = {h: Fraction(sum(r.base_failed for r in got if r.host == h), sum(r.host == h for r in got)) for h in rates}
    overall = sum(r.base_failed for r in got) / len(got)
    for h, rate in rates.items():  # shrunk towards the rate of all
        assert min(fails[h], overall) - 1e-9 <= rate <= max(fails[h], overall) + 1e-9
    good = host_verdicts({h: (sum(r.base_failed for r in got if r.host == h), sum(r.host == h for r in got)) for h in rates})
    assert not good["bad host"] and sum(good.values()) == len(good) - 1
    assert all(r.kept == (not r.base_failed and good[r.host]) for r in got)
    kept = qr.keep_good(corpora.frame(rows, data))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        (i, t) for i, t, s in data if not base_failed(measures(t)) and good[s]
    )
    assert qr.judge(corpora.frame(rows, [])).count() == 0 and qr.keep_good(corpora.frame(rows, [])).count() == 0


def prior(hosts):
    """Mean of (failed, all) pairs, and the correlation of two documents of a host, by moments."""
    total = sum(n for _, n in hosts)
    mean = Fraction(sum(f for f, _ in hosts), total)
    chance = mean * (1 - mean)
    spread = sum(n * (Fraction(f, n) - mean) ** 2 for f, n in hosts) - (len(hosts) - 1) * chance
    pairs = total - Fraction(sum(n * n for _, n in hosts), total) - (len(hosts) - 1)
    return float(mean), float(spread / (chance * pairs)) if chance and pairs > 0 else 0.0


def host_verdicts(hosts):
    """host -> kept, from host -> (failed, all), one host after the other."""
    mean, common = prior(list(hosts.values()))
    weight = 100.0 if common <= 0 or len(hosts) < 2 else 1 / common - 1 if common < 1 else 0.0
    kept = {}
    for h, (f, n) in hosts.items():
        m, c = prior([v for g, v in hosts.items() if g != h])
        limit = min(0.5, max(0.2, m + 3 * (m * (1 - m) * min(1, max(c, 1 / 101))) ** 0.5))
        rate = (f + mean * weight) / (n + weight)
        # The smallest rate that 2.33 deviations bring up to the one seen, by halving.
        low, high = 0.0, rate
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if mid + 2.33 * (mid * (1 - mid) / (n + weight)) ** 0.5 < rate else (low, mid)
        kept[h] = high <= limit
    return kept


def test_limits_follow_the_other_hosts(rows):
    def judged(hosts):
        table = rows([(h, f, n) for h, (f, n) in hosts.items()], "host string, f int, n int")
        table = table.select("host", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "f").select("host", (F.col("i") <= F.col("f")).alias("base_failed"))
        return {r.host: r.host_kept for r in qr.host_verdicts(table).collect()}

    alike = {f"h{i}": (20 + i % 5, 500) for i in range(20)}
    cases = [
        alike,  # no more apart than by chance: all stay
        {**alike, "x": (150, 500)},  # far from the others, if below a half
        {**alike, "x": (3, 4)},  # too few documents to be sure of
        {**alike, "x": (450, 500), "y": (480, 500), "z": (900, 1000)},  # several cannot hide one another
        {**{f"h{i}": (40 * i, 400) for i in range(11)}},  # hosts of all rates: the worse half goes, where sure
        {"only": (60, 100)}, {"clean": (0, 50), "spotless": (0, 9)}, {"a": (9, 9), "b": (0, 9)},
        {**{f"h{i}": (0, 300) for i in range(9)}, "x": (5, 300)},
    ]
    got = [judged(c) for c in cases]
    assert [{h for h, k in g.items() if not k} for g in got[:4]] == [set(), {"x"}, set(), {"x", "y", "z"}]
    assert all(got[8].values()) and not got[4]["h10"] and got[4]["h4"]
    for hosts, verdicts in zip(cases[:5], got):
        assert verdicts == host_verdicts(hosts)


def test_one_host_of_many_is_rejected_whole(rows):
    fine = [(i, corpora.prose(__import__("random").Random(i), 80), f"h{i % 8}") for i in range(80)]
    bad = [(500 + i, "too short", "worst") for i in range(200)] + [(900, fine[0][1], "worst")]
    got = {r.doc_id: r.kept for r in qr.judge(corpora.frame(rows, fine + bad)).collect()}
    assert not got[900] and all(got[i] for i, _, _ in fine)


def water(sizes):
    """Targets by sharing anew until none is above, in exact numbers."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: Fraction((total - sum(fixed.values())) * weight[s], sum(weight[r] for r in rest)) for s in rest}
        above = {s: Fraction(3 * sizes[s]) for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return {**fixed, **share}
        fixed |= above


def test_mixing_reaches_targets(rows):
    data = corpora.documents(7)
    docs = corpora.frame(rows, data).repartition(3)
    got = mixing.mix_documents(docs).collect()
    size = {}
    for _, t, s in data:
        size[s] = size.get(s, 0) + measures(t)[0]
    want = water(size)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, measures(t)[0]) for i, t, s in data)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    total = lambda rows: Counter({(r.doc_id, r.source, r.size): r.taken for r in rows})
    assert sum(r.taken for r in again) == sum(r.taken for r in got) and total(again).keys() == total(got).keys()
    assert mixing.mix_documents(corpora.frame(rows, [])).count() == 0
    assert {r.taken for r in mixing.mix_documents(corpora.frame(rows, [(1, None, "a"), (2, "", None)])).collect()} == {0}


def test_draws_agree_and_follow_quality(rows):
    data = [(i, ("word " if i % 2 else "word ### ") * 30, f"s{i % 2 * 0}") for i in range(400)] + [(1000 + i, "word " * 60, "t") for i in range(400)]
    docs = corpora.frame(rows, data)
    a = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    assert a == {r.doc_id: r.taken for r in mixing.mix_documents(docs.repartition(5)).collect()}
    t = mixing.mix_documents(docs.where("source = 's0'").union(corpora.frame(rows, [(5000 + i, "x " * 150, "r") for i in range(400)]))).collect()
    got = {r.doc_id: r for r in t if r.source == "s0"}
    assert sum(got[i].taken > got[i].epochs * got[i].size for i in range(1, 400, 2)) > sum(got[i].taken > got[i].epochs * got[i].size for i in range(0, 400, 2))


def test_rows_come_as_often_as_taken(rows):
    data = corpora.documents(8, 40)
    docs = corpora.frame(rows, data)
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    seen = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    want = Counter()
    for r in mixing.mix_documents(docs).collect():
        want[r.doc_id, r.source, r.size] += r.epochs + (2 * (r.taken - r.epochs * r.size) >= max(r.size, 1))
    by_size = Counter()
    for (i, s, t), n in seen.items():
        by_size[i, s, measures(t)[0]] += n
    assert by_size == Counter({k: n for k, n in want.items() if n})
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


