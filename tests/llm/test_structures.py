"""Conversation repair, the Jaccard join and tokenizer alignment against plain Python versions, through the registered queries too."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vacantia.llm import alignment, jaccard, repair
from vacantia.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {"u": "user", "a": "assistant"}
TO = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- repair
def cheapest(rows):
    """Edits by shortest path, cost first and audit second."""
    seen, heap = set(), [(0, "", 0, "0", ())]
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in "03":
            return cost, audit, out
        for r in "ua":
            if (q, r) in TO:
                heapq.heappush(heap, (cost + 2, audit + "I", i, TO[q, r], (*out, (None, r))))
        if i == len(rows):
            continue
        c, must, cut = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
        if must:
            continue
        if (q, c) in TO:
            heapq.heappush(heap, (cost + cut, audit + "K", i + 1, TO[q, c], (*out, (i, None))))
        for r in "ua":
            if (q, r) in TO:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, TO[q, r], (*out, (i, r))))


def repaired(table):
    said, ids = defaultdict(list), set()
    for c, t, r, x in table:
        ids.add(c)
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            said[c] += [(t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    out = []
    for c in ids:
        rows = sorted(said[c], key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).digest()))
        ts = [t for t, _, _ in rows if t is not None]
        n, seen, symbols = Counter(), set(), []
        for _, r, x in rows:
            fault = "blank" if not NOT_SPACE.search(x) else "duplicate" if (r, x) in seen else "truncated" if NOT_SPACE.findall(x)[-1] not in ".!?" else None
            n[fault] += 1
            seen.add((r, x))
            symbols.append((r[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        cost, audit, kept = cheapest(symbols)
        lines = [f"{NAMES[r]}:" if i is None else f"{NAMES[r] if r else rows[i][1]}:{rows[i][2]}" for i, r in kept]
        out.append((c, max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=5):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "user", "assistant", None, "sys", ""]
    texts = ["a.", "b", "  ", "", None, "c!", "long text?", "a.", "d \n", "e.\n", "x" * 30_000]
    rows = [(c, r.choice([k, k, k, k, r.randint(0, 9), None]), r.choice(roles), r.choice(texts)) for c in range(200) for k in range(r.randint(1, 12))]
    rows += [(None, r.choice([None, 3, 4, k]), r.choice(roles), r.choice(texts)) for k in range(200)]
    rows += [(8000, k, r.choice(roles[:3]), f"t{r.randint(0, 600)}{r.choice('.. !')}") for k in range(2000)]  # over several partitions
    return rows + [(8001, None, "user", "same.")] * 300 + [(8002, 5, "assistant", None)] * 20


def test_repair_equals_shortest_paths(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, code string, copies int").repartition(4)
    assert rows_of(repair.audited(df, repair.damage(df))) == repaired(rows)
    assert repair.audited(df.limit(0), repair.damage(df.limit(0))).count() == 0


def test_runs_are_solved_like_rows():
    r = random.Random(2)
    for _ in range(300):
        runs = [(r.randrange(9), r.choice([1, 1, 2, 3, 7, 40])) for _ in range(r.randint(1, 5))]
        flat = [("sua?"[s // 2] if s < 8 else "x", s == 8, s % 2 if s < 8 else 0) for s, n in runs for _ in range(n)]
        cost, audit, _ = cheapest(flat)
        letters, end = repair.solve(runs, repair.END, repair.START)
        assert letters + "I" * (repair.END[end] // 2) == audit and repair.costs_before(runs, repair.END)[0][0] == cost


def test_long_runs_need_no_steps():
    runs = [(2, 1_000_000), (8, 3_000_000)]
    letters, _ = repair.solve(runs, repair.END, repair.START)
    assert len(letters.replace("I", "")) == 4_000_000 and letters.endswith("D" * 3_000_000)


# ---------------------------------------------------------------- Jaccard join
def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append(frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    to = list(range(len(rows)))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    having, same = defaultdict(list), {}
    for k, x in enumerate(sets):
        if x in same and x:
            to[find(k)] = find(same[x])
            continue
        same[x] = k
        for j, n in Counter(j for t in x for j in having[t]).items():
            if 100 * n >= 85 * (len(x) + len(sets[j]) - n):
                to[find(k)] = find(j)
        for t in x:
            having[t].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], key=repr)


def alike(seed):
    """Odd rows, many near copies of one text, many texts around one passage, a chain whose ends are unlike."""
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(3000)]

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            p = r.randrange(len(w))
            if r.random() < 0.3:
                del w[p]
            else:
                w[p] = r.choice(voc)
        return w

    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  TWO\n"), (5, "a"), (None, "A"), (None, "alone with a null id here"), (6, "two one"), (7, "x" * 100_000)]
    base, passage, chain = ([r.choice(voc) for _ in range(n)] for n in (150, 60, 100))
    rows += [(r.randint(100, 9999), " ".join(edit(base, r.randint(0, 9)))) for _ in range(200)]
    for k in range(100):
        own = [r.choice(voc) for _ in range(r.randint(5, 120))]
        rows.append((10_000 + k, " ".join(own[:len(own) // 2] + passage + own[len(own) // 2:])))
    for k in range(50):
        rows.append((20_000 + k, " ".join(chain)))
        chain = edit(chain, r.randint(1, 3))
    return rows + [(30_000 + k, rows[r.randrange(9, 300)][1]) for k in range(30)]


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"slice_bytes": 20_000, "bucket_bytes": 20_000})])
def test_components_equal_all_pairs(spark, seed, how):
    rows = alike(seed)
    df = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in rows], "doc_id bigint, text string, set string, n int, class int").repartition(5)
    assert rows_of(jaccard.components(df, **how)) == components(rows)


def test_no_components(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.components(df).count() == 0


# ---------------------------------------------------------------- alignment
def aligned(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from vacantia.llm.bpe import byte_letters

    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: b for b, c in byte_letters().items()}
    count, per = Counter(), []
    for _, t in docs:
        per.append(None)
        if not t:
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        a_bytes = [bytes(back[c] for c in a_tok.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = (" " + t).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            continue
        ends = []
        for xs in (a_bytes, b_bytes):
            at, own = 0, []
            for x in xs:
                at += len(x)
                own.append(at)
            ends.append(own)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.append((a[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        count.update(links)
        per[-1] = (len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted([(i, 0, 0, 0, 0, 0, 0, "") if p is None else
                   (i, p[0], p[1], len(p[2]), len(p[2]), sum(count[x] == top[x[1]] for x in p[2]), sum(count[x] for x in p[2]), p[3])
                   for (i, _), p in zip(docs, per, strict=True)], key=repr)


VOCABULARIES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def test_alignment_equals_plain_python(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "<|endoftext|> <s> </s> <unk> <0x0A>"), (6, "  two  spaces\n\ttab\r\n"), (7, "日本語 naïve é ▁ x▁y"),
            (None, "null id"), (None, "null id"), (9, "\u0000nul"), (10, "x" * 3000), (11, " " * 3000), (12, " nbsp　ideographic ﬁ ligature"), (1, "a"),
            *((100 + k, f"word {k % 7} again and again {k % 3}") for k in range(40))]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, key string, slice int").repartition(3)
    assert rows_of(alignment.aligned(df, *VOCABULARIES)) == aligned(rows)
    assert rows_of(alignment.aligned(df, *VOCABULARIES, slice_bytes=64)) == aligned(rows)
    assert alignment.aligned(df.limit(0), *VOCABULARIES).count() == 0
    links = alignment.pair_table(df, *VOCABULARIES)
    assert links.agg({"count": "sum"}).first()[0] == sum(r[4] for r in aligned(rows))


def test_long_blanks_and_special_tokens_are_plain():
    both = alignment.aligner(*(v() for v in VOCABULARIES))
    for text in (" " * 70_000 + "x", "\n" * 60_000, "a" * 60_000, "<|endoftext|>" * 3):
        assert both.a_ids(text) == both.slow().encode(" " + text, add_special_tokens=False).ids


# ---------------------------------------------------------------- the registered queries over small tables
def test_registered_queries(spark, tmp_path):
    rows, said = alike(3)[:120], conversations(6)[:600]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == repaired(said)
    assert rows_of(QUERIES["op12_ngram_jaccard_join"](spark, str(tmp_path))) == components(rows)
    assert rows_of(QUERIES["op13_cross_tokenizer_alignment"](spark, str(tmp_path))) == aligned(rows)


def test_merged_words_have_the_ids_of_tokenizers():
    import random

    import numpy as np
    from vacantia.llm.packing import WordCoder
    from vacantia.llm.queries import vocabulary

    c, r = WordCoder(vocabulary("word_bpe_49k.json")()), random.Random(2)
    signs = "aaaeinorstthABÉß'’09.,!?<|>-_×ºµΣς\x0b\x1c\x85\xa0#"
    words = ["", "it's", "<|endoftext|>", "a<|startoftext|>b", "x" * 3000, "a\0b", "é"] + ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    assert c.merger and 1000 < len(c.merger.plain(words)) < len(words)
    slow = [np.array(e.ids, "<u4").tobytes() for e in c.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    learned = c.learn(words)
    assert [learned[w] for w in words] == slow
    texts = [" ".join(words[i:i + 9]).replace("!", "\n") for i in range(0, 900, 9)] + ["", " \t\r\n"]
    assert c.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in c.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_archives_are_read_in_linear_time():
    import os
    import time

    from vacantia.llm import warc as W

    records = [W.record(i, None, os.urandom(600), "0", None) for i in range(12_000)] + [os.urandom(100_000)]
    data = W.archive(records)
    t = time.process_time()
    assert list(W.records_of(data)) == records
    assert time.process_time() - t < 4  # 12,000 copies of what is left of 8 MB took longer
    try:
        list(W.records_of(data[:-1]))
    except Exception as e:
        assert isinstance(e, (ValueError, ArithmeticError)) or "zstd" in str(e).lower()
    else:
        raise AssertionError("a cut archive was read")
