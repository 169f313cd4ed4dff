"""Every dealt operator against a plain restatement, over a table with every awkward case, and over no rows."""

import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolo.llm import catalogue
from tremolo.llm.exact_dedup import PerfectHash, exact_dedup
from tremolo.llm.language_id import identify
from tremolo.llm.line_dedup import common_blocks, line_dedup, patience, without_lines
from tremolo.llm.mixing import mix, repeated
from tremolo.llm.near_dedup import near_dedup
from tremolo.llm.packing import pack, sequence_sizes
from tremolo.llm.pii import find_pii, pii_digest
from tremolo.llm.substring_dedup import substring_dedup
from tremolo.llm.token_counts import Counter as PieceCounter
from tremolo.llm.token_counts import token_counts
from tremolo.llm.topk_search import top_k

ROWS = brute.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.table(spark, [])


def rows_of(df, columns):
    return rows(df, *columns)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_exact(docs, none):
    got = exact_dedup(docs).withColumn("sha", F.lower(F.hex("digest")))
    assert brute.same(rows(got, "doc_id", "keep_id", "group_size", "kept", "sha"), brute.exact(ROWS))
    assert exact_dedup(none).count() == 0


def test_exact_whatever_is_history(docs):
    want = brute.exact(ROWS)
    for old in (F.lit(True), F.lit(False), F.col("doc_id") < 105):
        got = exact_dedup(docs, old).withColumn("sha", F.lower(F.hex("digest")))
        assert brute.same(rows(got, "doc_id", "keep_id", "group_size", "kept", "sha"), want)


def test_perfect_hash_is_minimal_and_survives_storage():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    h = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys)) == list(range(5000))


def test_substring(docs, none):
    assert brute.same(rows(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text"), brute.substring(ROWS))
    assert substring_dedup(none).count() == 0


def test_substring_passages_in_parts(spark, monkeypatch):
    """A shard whose passages don't fit in one part: what the parts mark is put together."""
    import random

    import tremolo.llm.substring_dedup as sub

    r = random.Random(5)
    shared = [brute.prose(r, 30).split() for _ in range(12)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(4):
            p = r.choice(shared)
            at = r.randrange(10)
            w += brute.prose(r, 5).split() + p[at : at + r.randint(10, 20)]
        rows.append((i, " ".join(w), None, None, 1))
    want = brute.substring(rows)
    assert sum(n for _, _, n, _ in want) > 500
    for size in (300, 1 << 24):
        monkeypatch.setattr(sub, "PART_BYTES", size)
        assert brute.same(rows_of(substring_dedup(brute.table(spark, rows)), ["doc_id", "n_words", "n_removed", "kept_text"]), want)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near(docs, k, percent):
    assert brute.same(rows(near_dedup(docs, k, percent), "doc_id", "n_shingles", "component_id", "kept"), brute.near(ROWS, k, percent))


def test_near_finds_links_that_no_star_has(spark):
    """Copies with growing edits: a centre that is far from others hides links between them."""
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    table = []
    for i in range(80):
        w = list(base)
        for j in r.sample(range(120), i % 9):
            w[j] = f"e{i}_{j}"
        table.append((i, " ".join(w), None, None, None))
    got = rows(near_dedup(brute.table(spark, table), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert brute.same(got, brute.near(table, 3, 85))


def test_near_no_rows(none):
    assert near_dedup(none).count() == 0


def test_patience():
    a, b = list("abcdefg"), list("xabcyefgz")
    assert [(a[i], b[j]) for i, j in patience(a, b)] == [(c, c) for c in "abcefg"]
    assert common_blocks(patience(a, b)) == [(1, 4), (5, 8)]
    assert patience([], list("ab")) == [] and patience(list("aa"), list("aa")) == [(0, 0), (1, 1)]
    both = [1, 2, 1, 3] * 500
    assert len(patience(both, both)) == 2000


def test_lines(docs, none, spark):
    got = {(r.doc_id, r.n_lines, r.kept_text) for r in line_dedup(docs).collect()}
    by = {d: (n, t) for d, n, t in got if d not in (None, 10)}
    text = {d: t for d, t, *_ in ROWS}
    assert all(by[d] == (text[d].count("\n") + 1, text[d]) for d in (11, 12, 403, 405, 410))  # nothing earlier shares a line
    assert by[400] == (0, "") and by[401] == (0, "")
    assert by[102][1] == "" and by[104][1] == ""  # equal texts: all but the first
    assert line_dedup(docs).count() == len(ROWS) and line_dedup(none).count() == 0
    shared = "a line that both documents hold and that is long enough"
    two = brute.table(spark, [(1, f"first\n{shared}\nmore", None, None, 1), (2, f"second\n\n{shared}\nend", None, None, 2), (None, shared, None, None, 3)])
    assert {(r.doc_id, r.n_removed, r.kept_text) for r in line_dedup(two).collect()} == {(1, 0, f"first\n{shared}\nmore"), (2, 1, "second\n\nend"), (None, 0, shared)}


def test_lines_keeps_columns_and_drops_what_is_empty(docs):
    out = without_lines(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert 102 not in got and got[11] == 1 and got[10] == 4


def test_pii(docs, none):
    found = pii_digest(find_pii(docs)).collect()
    assert len(found) == len(ROWS)
    import hashlib

    want = Counter((d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute.pii(t)).encode()).hexdigest()) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, r.base_sha256) for r in found) == want
    one = next(r for r in found if r.doc_id == 410)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    assert find_pii(none).count() == 0


def test_pii_learns_a_context(spark):
    """Seeds behind one word teach it; an identifier that no base pattern matches is found there and nowhere else."""
    table = [(i, f"please write ip: 10.0.{i}.7 today and then order 1234567 now", None, None, 1) for i in range(40)]
    table += [(100, "write ip: 999.0.0.7000 today", None, None, 1), (101, "order 999.0.0.7000 today", None, None, 1)]
    got = {r.doc_id: r for r in pii_digest(find_pii(brute.table(spark, table))).collect()}
    assert got[100].spans == "ip:10:22" and got[100].n_ip == 0 and got[100].n_added == 1
    assert got[101].spans == "" and all(got[i].n_added == 0 for i in range(40))


def test_pii_added_spans_equal_plain_loops(spark):
    """Contexts on either side, keys, credentials and words that introduce other things, over random texts."""
    import random

    r = random.Random(12)
    filler = "lorem ipsum dolor sit amet order total page see".split()

    def token(i):
        some = [f"10.{i % 200}.3.{i % 90}", f"user{i}@mail.org", f"999.1.{i}.70000", f"user{i}(at)mail7.org", f"{1000 + i}", f"password=abc{i:06d}", f"phrase=abc{i % 40:06d}", f"x{i}=9{i}77", "AKIA" + "A1B2C3D4E5F6G7H8"]
        return r.choices(some, (12, 12, 1, 1, 4, 4, 3, 2, 1))[0]

    before = {"ip": ["addr", "from"], "mail": ["write", "contact"], "other": filler}
    table = []
    for i in range(260):
        parts = []
        for _ in range(r.randint(0, 4)):
            t = token(r.randint(0, 199))
            kind = "ip" if t.count(".") == 3 else "mail" if "mail" in t else "other"
            parts += [r.choice(filler), r.choice(before[kind] if r.random() < 0.97 else filler), t, *([r.choice(["please", "now"])] if r.random() < 0.5 else [])]
        table.append((i, " ".join(parts), None, None, 1))
    table += [(900, None, None, None, 1), (None, "addr 999.1.5.70000 now", None, None, 1), (901, "1234567", None, None, 1), (902, "n " + "1234 " * 700, None, None, 1)]
    want = brute.pii_added(table)
    got = {r.doc_id: r for r in find_pii(brute.table(spark, table)).collect()}
    added = 0
    for (d, text, *_), (more, secrets) in zip(table, want, strict=True):
        base = {(list(brute.PII).index(k), s, e) for k, s, e in brute.pii(text)}
        assert [tuple(x) for x in got[d].spans] == sorted(base | set(more)) and [tuple(x) for x in got[d].secrets] == secrets
        added += len(more)
    assert added > 20


def test_mix(docs, none):
    m = mix(docs).collect()
    assert len(m) == len(ROWS) and mix(none).count() == 0
    assert Counter((r.doc_id, r["size"]) for r in m) == Counter((d, len(brute.words(t))) for d, t, *_ in ROWS)
    names = sorted({r.source for r in m if r.source is not None}) + [None]
    size = {s: sum(r["size"] for r in m if r.source == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:  # share out, clamp, again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    for s in names:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in m if r.source == s)
        assert abs(sum(r.taken for r in m if r.source == s) - target[s]) <= 1 + sum(r["size"] == 0 for r in m)
    assert all(0 <= r.taken <= 2 * r["size"] for r in m)
    assert Counter(map(tuple, m)) == Counter(map(tuple, mix(docs.repartition(5)).collect()))


def test_repeated(docs):
    m, out = mix(docs), repeated(docs)
    assert out.schema == docs.schema
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert r["size"] == "x" and r["taken"] == "x"  # extra columns stay, whatever their names
    want = Counter()
    for r in m.collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_mix_clashing_columns(spark):
    names = ["_src", "_digest", "_words", "_key", "_mix_src", "_t", "_rest", "Size"]
    t = spark.createDataFrame([(i, "w " * (i + 1), f"s{i % 2}", *["x"] * 8) for i in range(9)], f"doc_id long, text string, source string, {', '.join(f'{x} string' for x in names)}")
    m = mix(t)
    assert m.columns == ["doc_id", "text", "source", *names[:-1], "size", "source_size", "target", "taken"] and {r["_src"] for r in m.collect()} == {"x"}
    assert repeated(t).columns == t.columns


def test_mix_equals_its_sql(spark, tmp_path):
    """The water-fill and the cut-off by SQL, over rows with ties, nulls and repeated ids."""
    import duckdb

    rows = [(d, t, None, s, 1) for d, t, _, s, _ in ROWS] + [(7, "a b c d e", None, "s1", 1)] * 30
    brute.table(spark, rows).select("doc_id", "text", "source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["op7_mixing"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()['op7_mixing']})").fetchall()
    assert brute.same(rows_of(got, columns), want)


def test_pack(docs, none):
    from tokenizers import Tokenizer

    spec = catalogue.tokenizer_spec()
    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    want = Counter((d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for d, x, *_ in ROWS)
    p = pack(docs, spec).collect()
    for s in {r.sequence_id for r in p}:
        at = 0
        for r in sorted((r for r in p if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at & (at - 1)) == 0
    unique = {d: ids for (d, ids), n in want.items() if d is not None and n == 1 and sum(k[0] == d for k in want) == 1}
    for d, ids in unique.items():
        at = 0
        for r in sorted((r for r in p if r.doc_id == d), key=lambda r: r.start):
            piece = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece.tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in p) == sum(len(ids) * n for (_, ids), n in want.items())
    assert pack(none, spec).count() == 0


def test_pack_mixture(spark):
    """Every full window holds every source at its share, within a quantum; sources of all sizes."""
    import random

    import tremolo.llm.packing as packing

    r = random.Random(9)
    table = [(i, brute.prose(r, 400), None, "big" if i % 3 else f"small{i % 4}", 1) for i in range(90)]
    spec, whole = catalogue.tokenizer_spec(), packing.GROUP_IDS
    for ids in (whole, 1 << 13):
        packing.GROUP_IDS = ids
        try:
            p = pack(brute.table(spark, table), spec).collect()
        finally:
            packing.GROUP_IDS = whole
        source = {i: s for i, _, _, s, _ in table}
        total, held, room = Counter(), {}, Counter()
        for x in p:
            total[source[x.doc_id]] += x.length
            room[x.sequence_id] += x.length
            held.setdefault(x.sequence_id, Counter())[source[x.doc_id]] += x.length
        full = [s for s in held if room[s] == 1024]
        first = {min(s for s in full if s >> 32 == g) for g in {s >> 32 for s in full}}
        assert len(full) > 20 and len(total) == 5
        for s in full:
            for name, n in total.items():
                off = abs(held[s][name] - 1024 * n / sum(total.values()))
                assert off <= (packing.QUANTUM + 8 if s in first else 8)
    assert sequence_sizes(2 * 1024 + 700, 1024) == [1024, 1024, 512, 128, 32, 16, 8, 4]


def test_pack_mixture_on_the_tables(spark):
    """Twenty sources: no full window is further off a source's share than a quantum."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    total, held, room = Counter(), {}, Counter()
    for x in pack(docs, catalogue.tokenizer_spec()).collect():
        total[source[x.doc_id]] += x.length
        room[x.sequence_id] += x.length
        held.setdefault(x.sequence_id, Counter())[source[x.doc_id]] += x.length
    worst = max(abs(held[s][k] - 1024 * n / sum(total.values())) for s in held if room[s] == 1024 for k, n in total.items())
    assert worst <= 32


def test_takes():
    from tremolo.llm.packing import takes

    got = takes(np.array([700, 300, 24]), np.zeros(3), [512, 512])
    assert got.sum(axis=1).tolist() == [512, 512] and got.sum(axis=0).tolist() == [700, 300, 24] and abs(got - [[350, 150, 12]]).max() <= 1
    assert takes(np.array([10, 6]), np.array([4.0, -4.0]), [8, 8]).tolist() == [[7, 1], [3, 5]]  # a debt is paid first
    one = takes(np.array([5, 1019]), np.array([900.0, -900.0]), [1024])
    assert one.tolist() == [[5, 1019]]


def test_pack_weights(spark):
    """Given weights, windows hold them until a source runs out; deficits go on over groups and no id is lost."""
    import random

    import tremolo.llm.packing as packing

    r = random.Random(4)
    table = [(i, brute.prose(r, 300), None, "big" if i % 4 else "small", 1) for i in range(80)]
    spec, whole = catalogue.tokenizer_spec(), packing.GROUP_IDS
    packing.GROUP_IDS = 1 << 13
    try:
        p = pack(brute.table(spark, table), spec, weights={"big": 1, "small": 1}).collect()
    finally:
        packing.GROUP_IDS = whole
    source = {i: s for i, _, _, s, _ in table}
    size = {s: sum(x.length for x in p if source[x.doc_id] == s) for s in ("big", "small")}
    assert size["big"] + size["small"] == sum({x.doc_id: x.doc_tokens for x in p}.values())
    groups = sorted({x.sequence_id >> 32 for x in p})
    assert len(groups) > 3
    seen = Counter()
    for g in groups:
        for x in p:
            if x.sequence_id >> 32 == g:
                seen[source[x.doc_id]] += x.length
        both = sum(seen.values()) / 2
        assert abs(seen["small"] - min(both, size["small"])) <= 2 * packing.QUANTUM + 1
    with pytest.raises(ValueError, match="every source"):
        pack(brute.table(spark, table), spec, weights={"big": 1})


def test_schedule():
    from tremolo.llm.packing import Schedule

    s = Schedule([100, 30], [1.0, 1.0])
    assert s.given.tolist() == [0, 60, 130] and s.all_by(np.array([10.0, 40.0, 100.0])).tolist() == [20, 70, 130] and s.time_of(70) == 40


def test_long_texts_in_pieces(monkeypatch):
    """Pieces give what whole texts give: words, hashes, n-gram counts, token ids."""
    import pyarrow as pa
    import tremolo.llm.bpe as bpe
    import tremolo.llm.language_id as lang
    import tremolo.llm.words as words

    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abc def GHI é È\t\n'sß "), n)) for n in (0, 5, 3000, 700, 9000)] + ["z" * 4000 + " end", " " * 3000]
    column = pa.array([*texts, None])

    def everything():
        out = []
        for row, raw, at in words.text_slices(column):
            s, e, first = words.word_spans(raw, at)
            h = words.word_hashes(raw, s, e)
            out += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        grams = np.concatenate([lang._counts(raw, at) for _, raw, at in words.text_slices(column)])
        ids = [i[a:b].tolist() for _, i, at in bpe.Encoder(catalogue.tokenizer_spec()).ids(column) for a, b in zip(at[:-1], at[1:])]
        return out, grams.tolist(), ids

    whole = everything()
    for step in (64, 500):
        words._POWERS.clear()
        monkeypatch.setattr(words, "STEP_BYTES", step)
        monkeypatch.setattr(lang, "STEP_BYTES", step)
        monkeypatch.setattr(bpe, "_STEP", step)
        assert everything() == whole
    words._POWERS.clear()


def test_language_equals_its_machines(spark, docs):
    """Predictions over given machines, restated: n-grams counted one by one, then families, then votes of duels with their ties."""
    import tremolo.llm.language_id as lang

    r = np.random.default_rng(1)
    names = ["de", "en", "nl", "fr", "es", "fi", "xx"]
    model, table = lang.Hierarchy(names), {}
    for yes, no in model.machines():
        w = np.round(r.normal(size=lang.DIMENSIONS + 1) * 4).astype(np.float32) / 4
        table[yes, no] = (np.zeros_like(w) if (yes, no) == ("en", "nl") else w, float(r.uniform(0.5, 2)))  # a duel that is always a tie
    model.take(table)

    def features(text):
        raw = bytes(text.encode())
        low = bytearray()
        for i, c in enumerate(raw):
            ch = c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
            if i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
                ch += 32
            if ch != 32 or not low or low[-1] != 32:
                low.append(ch)
        x = np.zeros(lang.DIMENSIONS)
        for k in range(1, 5):
            for i in range(len(low) - k + 1):
                g = int.from_bytes(low[i : i + k], "big")
                if g != 32:
                    x[((g + k * 0x51ED27) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        x = np.sqrt(x)
        return x / max(np.linalg.norm(x), 1e-9)

    def margin(x, pair):
        w, slope = table[pair]
        m = float(x @ w[:-1] + w[-1])
        return m, 1 / (1 + np.exp(-np.clip(m * slope, -30, 30)))

    texts = [t for _, t, *_ in ROWS if t and any(map(str.isalpha, t)) and len(t) < 2000]
    import pyarrow as pa

    got = [(n, p) for _, x in lang._features(pa.array(texts)) for n, p in zip(*model.predict(x), strict=True)]
    assert len(got) == len(texts)
    for text, (name, score) in zip(texts, got, strict=True):
        x = features(text)
        tops = {f: margin(x, ("/" + f, "*")) for f in model.families}
        family = max(model.families, key=lambda f: (tops[f][0], [-ord(c) for c in f]))
        want = tops[family][1] / sum(p for _, p in tops.values())
        members = [k for k in sorted(names) if lang.family(k) == family]
        votes, sums, sure = ({k: 0.0 for k in members} for _ in range(3))
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                m, p = margin(x, (a, b))
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                sure[a] += p
                sure[b] += 1 - p
        best = max(members, key=lambda k: (votes[k], round(sums[k], 4), [-ord(c) for c in k]))
        if len(members) > 1:
            want *= sure[best] / (len(members) - 1)
        assert name == best and abs(score - want) < 1e-4


def test_language_repeated_labelled_rows(spark):
    """Rows that repeat an id and label count once: the machines are the same."""
    table = [(i, f"{'the and of' if i % 2 else 'der und die'} {i}", "en" if i % 2 else "de", "s", 1) for i in range(60)]
    one, two = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in identify(brute.table(spark, t)).collect()} for t in (table, table + table[:40] + table[:40]))
    assert one == two


def test_language_columns_that_clash(spark):
    t = spark.createDataFrame([(i, "the of and that" if i % 2 else "der die und das", "en" if i % 2 else "de", "a", "b", "c") for i in range(40)], "doc_id long, text string, lang string, _text string, _lang_text string, lang_pred string")
    got = identify(t)
    assert [c for c in got.columns if c.startswith("_")] == ["_text", "_lang_text"] and {r["_text"] for r in got.collect()} == {"a"}


def test_language_no_cap_on_languages(spark):
    """More languages than the sample has rows: all are learned."""
    from tremolo.llm.language_id import fit

    table = [(i * 10 + j, f"text {i} " * 5, f"z{i}" if i % 2 else ["en", "de", "nl", "sv"][i // 2 % 4], "s", 1) for i in range(160) for j in range(4)]
    assert len(fit(brute.table(spark, table), max_sample=35).langs) == 84


def test_language(docs, none):
    got = identify(docs).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert identify(none).count() == 0


def test_language_held_out(spark):
    """Two related languages and a third: accuracy on the rows that were not learned from."""
    import random

    r = random.Random(2)
    # A few frequent words of three languages.
    words = {"en": "the of and that with from which there", "de": "der die und das nicht mit sich eine", "fr": "le les des une dans avec pour est"}
    table = [(i, " ".join(r.choice(words[k].split()) for _ in range(30)), k, "s", 1) for i, k in enumerate(list(words) * 60)]
    got = identify(brute.table(spark, table)).select("doc_id", "lang", "lang_pred").collect()
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and sum(x.lang == x.lang_pred for x in held) / len(held) > 0.95


def test_language_without_labels(spark):
    t = brute.table(spark, [(1, "some text", None, None, 1), (2, None, None, None, None)])
    assert {(r.doc_id, r.lang_pred) for r in identify(t).collect()} == {(1, "und"), (2, "und")}


def test_topk(spark):
    r = np.random.default_rng(4)
    table = [(i, [float(x) for x in r.integers(-3, 3, 6) / 2]) for i in range(700)]
    table += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf"), 1.0]), (None, [1.0]), (100, table[100][1]), (1100, []), (1200, [1e300, 1.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "y") for x in table], "vec_id long, embedding array<double>, score string").repartition(4)
    got = rows(top_k(df, F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id", "score")
    ok = [(i, [min(max(int(np.floor(min(1024 * x, 1e30))), -(1 << 62)), 1 << 62) for x in v]) for i, v in table if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 100 == 0}.items():
        s = [(-min(max(sum(a * b for a, b in zip(v, w, strict=False)), -(1 << 62)), 1 << 62), i) for i, w in ok if i != q]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(sorted(s)[:10])]
    assert brute.same(got, want)
    assert top_k(df.limit(0), F.lit(True)).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"  # what all operators set


def test_topk_fewer_than_k(spark):
    df = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert brute.same(rows(top_k(df, F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id", "score"), [(100, 1, 1, 2 << 20), (100, 2, 2, -(1 << 20))])


def test_tokens(docs, none):
    from tokenizers import models

    v = catalogue.unigram_vocabulary()
    m = models.Unigram(v, 0, True)
    want = Counter((d, len(brute.words(t)), sum(len(m.tokenize("▁" + w)) for w in brute.words(t))) for d, t, *_ in ROWS)
    assert Counter(rows(token_counts(docs, v), "doc_id", "n_words", "n_tokens")) == want
    assert token_counts(none, v).count() == 0


def test_token_ties_and_unknown():
    import random

    from tokenizers import models

    r = random.Random(8)
    pieces = [("<unk>", 0.0)] + [(p, float(r.randint(-4, -1))) for p in {"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))) for _ in range(40)}]
    c, m = PieceCounter(pieces), models.Unigram(pieces, 0, False)
    some = ["".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(500)]
    assert c.count(some).tolist() == [len(m.tokenize("▁" + w)) for w in some]


def test_registered_once_for_each_number():
    names = list(catalogue.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize("old", [False, True])
def test_exact_hot_digest(spark, old):
    """One digest over nearly all rows, new or historical."""
    import tremolo.llm.exact_dedup as exact

    rows = spark.range(0, 30_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise("Hot").alias("text"))
    digests, groups = exact.exact_groups(rows, F.lit(old), exact.Scratch(spark, "hot"))
    got = {r.n: r.c for r in groups.groupBy("n").agg(F.count("*").alias("c")).collect()}
    assert got == {1: 300, 29_700: 1} and digests.count() == 30_000 and groups.filter("n > 1").first()["winner"] == 29_999
