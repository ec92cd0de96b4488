"""Spelling variants, conversation repair and sharding against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pagewright.llm import conversation, queries, sharding, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, id long, shard string, digest int, node int"
TALKS = "conv_id long, turn long, role string, text string, kind string, times int, costs string, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TABLES = ("documents", "conversations")


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair", "op13_sharding"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


# --- Spelling -------------------------------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    by_size = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_size[len(w) + k] if one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def spelling_rows():
    rng = random.Random(3)
    base = ["steam", "stream", "streams", "aaaaa", "aaaaaa", "aaaaaaa", "Àéèçû", "àéèçû", "ÀÉÈÇÛ", "river", "rivers", "rover", "xriver", "abcde", "bacde", "vwxyz"]
    texts = [None, "", "12 -- !", "short abcd", "a" * 3000 + " " + "a" * 3001 + " " + "a" * 2999 + "b"]
    texts += [texts[-1], texts[-1], "quiet " * 40 + "quieta " * 16 + "quietab " * 4]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(5, 80)):
            w = rng.choice(base[: rng.randrange(1, len(base)) + 1])
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + rng.choice("aestÿ") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + rng.choice("aestÉ") + w[i:]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        texts.append(rng.choice([" ", "_", "1", "\n"]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, texts[-1]), (2**60 + 1, texts[-2]), rows[-1], rows[-1]]


def test_variants_are_brute_force(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "clash", 5, "x", 1, 2) for d, t in rows], DOCS)
    got = [tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(root != form for _, form, root, *_ in want if form)  # chains of two and more


def test_equal_keys_of_other_words_are_told_apart(spark, monkeypatch):
    """All keys equal: the strings alone decide."""

    def same(codes):
        return np.zeros(len(codes), np.uint64), np.zeros(codes.shape, np.uint64)

    rows = [(i, " ".join(w for w in ("stream", "steam", "streak", "bottle", "battle") for _ in range(3 + 5 * (w == "stream")))) for i in range(2)]
    monkeypatch.setattr(spelling, "deletion_keys", same)
    keys = list(spelling._keys([__import__("pandas").DataFrame({"id": [0, 1], "word": ["stream", "steam"]})]))
    assert {k for frame in keys for k in frame["key"]} == {0}
    key, pos, last = np.zeros(4, np.int64), np.array([-1, -1, 0, 1]), np.array([False, False, True, True])
    replaced, shifted = spelling.candidates(key, pos, last)
    assert list(replaced) == [False] * 4 and list(shifted) == [True] * 4
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "clash", 5, "x", 1, 2) for d, t in rows], DOCS)
    assert {tuple(r) for r in spelling.spelling_variants(docs).collect()} == {(w, f, r, n, k, m) for w, f, r, n, k, m in variants(rows)}


def test_deletion_keys_are_keys_of_the_shorter_word():
    rng = random.Random(1)
    for _ in range(50):
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(2, 12)))
        as_codes = lambda t: np.array([[ord(c) for c in t]], np.uint32)
        _, without = spelling.deletion_keys(as_codes(w))
        for i in range(len(w)):
            assert spelling.deletion_keys(as_codes(w[:i] + w[i + 1 :]))[0][0] == without[0, i]


def test_batches_of_any_size_meet():
    rng = random.Random(2)
    rows = sorted((rng.randrange(6), rng.randrange(-1, 3), i, rng.random() < 0.5) for i in range(200))
    frame = __import__("pandas").DataFrame(rows, columns=["key", "pos", "id", "last"])
    frame.loc[frame["pos"] < 0, "last"] = False
    found = lambda size: {tuple(r) for f in spelling._met(frame.iloc[k : k + size] for k in range(0, 200, size)) for r in f.itertuples(index=False, name=None)}
    assert found(1) == found(7) == found(200)


# --- Conversations --------------------------------------------------------------------------------------------------


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """The smallest (cost, audit) over all scripts, by Dijkstra over whole audits; rows: (role, fault)."""
    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (i, roles, audit) in seen:
            continue
        seen.add((i, roles, audit))
        ok = lambda r: re.fullmatch("s?(ua)*u?", r)
        for way in "ua":
            if ok(roles + way):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + way))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for price, mark, way in ((0, "K", role[:1]), (1, "R", "u"), (1, "R", "a")):
                    if way and ok(roles + way):
                        heapq.heappush(heap, (cost + price + extra, audit + mark, i + 1, roles + way))


def repaired_by_hand(rows, damage=True):
    after, out = damaged_rows(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], Counter()
        for _, role, text in own:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit = cheapest(marked)
        parts, i, roles = [], 0, ""
        for edit in audit:
            role, text = own[i][1:] if edit != "I" else ("", "")
            i += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if roles[-1:] == "u" else "user"
                roles += role[0]
                parts.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def talks(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in [None, 2**60 + 1, *range(n)]:
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool", "userx"])
            text = rng.choice([None, "", " \n", "Yes.", "No", "Why?", "A\n b!", "é", f"own {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 3]), role, text))
    return rows + rng.sample(rows, 20)


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("stretch", [1, 2, 4096])
def test_repair_is_brute_force(spark, stretch, damage):
    rows = talks(stretch)
    frame = spark.createDataFrame([(*r, "k", 1, "c", "d") for r in rows], TALKS).repartition(5)
    got = conversation.repair(frame, conversation.RepairParams(stretch=stretch), damage=damage).collect()
    want = repaired_by_hand(rows, damage)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_repair_of_a_long_conversation(spark):
    """One conversation over many tasks and stretches gives what it gives in one."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"own {t}.", f"own {t}."])) for t in range(900)] + [(2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = conversation.repair(frame.coalesce(1), conversation.RepairParams(stretch=10**6)).collect()
    many = conversation.repair(frame.repartition(7), conversation.RepairParams(stretch=37)).collect()
    assert sorted(one) == sorted(many)
    assert len(next(r for r in one if r.conv_id == 1).audit) >= 900
    written = conversation.repaired(frame).orderBy("conv_id", "position").collect()
    for r in one:
        whole = "\n".join(f"{w.role}:{w.text}" for w in written if w.conv_id == r.conv_id)
        assert hashlib.sha256(whole.encode()).hexdigest() == r.repaired_sha256


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TALKS)
    assert conversation.repair(empty, damage=True).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversation.repair(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"), damage=True).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    with pytest.raises(ValueError):
        conversation.repair(empty, conversation.RepairParams(insert=0))


# --- Sharding -------------------------------------------------------------------------------------------------------


def shard_rows(n=400, seed=4):
    rng = random.Random(seed)
    texts = [None, "", " ", "copied text " * 3, "É" * 700]
    rows = []
    for i in range(n):
        text = rng.choice(texts) if i % 4 == 0 else f"{i} " + "word " * rng.randrange(1, 120)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), None if i % 17 == 0 else len(text or ""), "w", 1, "s", 3, 4))
    return [*rows, rows[7], rows[7], (None, "no id", "en", "a", 5, "w", 1, "s", 3, 4), (2**60 + 1, "big id", "en", "a", 2**62, "w", 1, "s", 3, 4)]


def check_shards(got, rows, shards, slack):
    size = lambda t: len((t or "").encode()) + 1
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows), key=key)
    weights, slots = Counter(), defaultdict(list)
    for r in got:
        weights[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(weights) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(weights.values()) / shards
    assert all(abs(weights[k] - target) <= slack * target for k in range(shards)), weights
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_near_equal(spark, shards):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = sharding.sharded(docs, sharding.ShardParams(shards=shards)).collect()
    check_shards(got, rows, shards, 0.1)


def test_tree_is_brute_force(spark):
    """Every cut, by sorting a node's points whole."""
    rows = [r for r in {r[0]: r for r in shard_rows(seed=6) if r[0] is not None}.values()]
    params = sharding.ShardParams(shards=5, dimensions=("source", "n_chars"))
    got = {r.doc_id: r.shard for r in sharding.sharded(spark.createDataFrame(rows, DOCS), params).collect()}
    md5 = lambda t, k: int(hashlib.md5(t.encode()).hexdigest()[:k], 16)
    chars = [r[4] for r in rows if r[4] is not None]
    groups = defaultdict(list)
    for r in rows:
        places = (0 if r[3] is None else md5(r[3], 3), 0 if r[4] is None else (r[4] - min(chars)) * 4095 // (max(chars) - min(chars)))
        groups[r[1] or ""].append((r[0], len((r[1] or "").encode()) + 1, places))
    heaviest = sum(x[1] for g in groups.values() for x in g) // (5 * 50)
    points = []
    for text, g in groups.items():
        if sum(x[1] for x in g) <= heaviest:
            points.append(([d for d, _, _ in g], sum(x[1] for x in g), min(g)[2], md5(text, 6)))
        else:
            points += [([d], w, places, md5(str(d), 6)) for d, w, places in g]
    want = {}

    def cut(some, shards, first):
        if shards == 1:
            want.update((d, first) for ids, *_ in some for d in ids)
            return
        spread = [max(p[2][k] for p in some) - min(p[2][k] for p in some) for k in range(2)]
        k = spread.index(max(spread))
        left, weight, share = [], 0, sum(p[1] for p in some) * (shards // 2) / shards
        some = sorted(some, key=lambda p: (p[2][k], p[3]))
        for p in some:
            if weight + p[1] / 2 <= share:
                left.append(p)
            weight += p[1]
        cut(left, shards // 2, first)
        cut(some[len(left) :], shards - shards // 2, first + shards // 2)

    cut(points, 5, 0)
    assert got == want


def test_shards_of_one_text(spark):
    """A text that is nearly all of the table is cut; light groups stay together."""
    rows = [(i, "the same text again", "en", "a", 19, "w", 1, "s", 3, 4) for i in range(900)] + [(1000 + i, f"pair {i // 2} " + "x" * 20, "en", "a", 30, "w", 1, "s", 3, 4) for i in range(100)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS), sharding.ShardParams(shards=4)).collect()
    check_shards(got, rows, 4, 0.05)
    of = {r.doc_id: r.shard for r in got}
    assert all(of[1000 + 2 * i] == of[1001 + 2 * i] for i in range(50))


def test_shards_by_target(spark, tmp_path):
    rows = shard_rows(60)
    docs = spark.createDataFrame(rows, DOCS)
    total = sum(len((r[1] or "").encode()) + 1 for r in rows)
    got = sharding.sharded(docs, sharding.ShardParams(target_bytes=total // 6 + 1)).collect()
    assert {r.shard for r in got} == set(range(6))
    sharding.write_shards(docs, str(tmp_path / "shards"), sharding.ShardParams(shards=2))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*docs.columns, "shard_"] and back.count() == len(rows)
    assert back.select("shard_").distinct().count() == 2


def test_shards_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.sharded(empty).count() == 0
    bare = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "doc_id long, text string")
    assert len(sharding.sharded(bare).collect()) == 3
    with pytest.raises(ValueError):
        sharding.sharded(bare, sharding.ShardParams(shards=0))
