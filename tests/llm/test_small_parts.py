"""Parts of the corpus operators that need no session, against plain versions and the libraries themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from merceris.llm import bpe, gif, jaccard, neighbours, packing, quality, repeats, suffixes, token_counts  # noqa: E402

ODD = ["", "a", " ", "  \n\n x  ", "don't 'S he'll'", "日本語テキスト😀" * 30, "aaaa" * 300, "x" * 5000, "é́ ß\x1c\x85\xa0z", "<|endoftext|> a<|endoftext|>", "".join(map(chr, range(1, 1500)))]


def mixed(n: int) -> list[str]:
    r = random.Random(1)
    parts = ["'", "s", "re", "'ve", " ", "  ", "\n", "\t", "\xa0", "A", "z9", "12", "²", "é", "日本", "😀", "!", "$%", " '", "aaaa", "the"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_bpe_equals_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine, texts = bpe.Codec(ranks, P.PATTERN), ODD + mixed(300)
    for text, ids in zip(texts, mine.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert mine.decode(ids) == text.encode()


def test_one_tree_and_many_trees_agree():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    mine, r = bpe.Codec(ranks, P.PATTERN), random.Random(2)
    pieces = [bytes(r.choice(b"aehtns. r") for _ in range(r.randint(2, 32))) for _ in range(200)]
    many = mine.encode_many(pieces, 32)
    for p, x in zip(pieces, many, strict=True):
        ids = np.frombuffer(x, "<u4").tolist()
        assert b"".join(mine.tokens[i] for i in ids) == p
        assert ids == bpe.encode_piece(p, ranks)


def test_token_counts_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ODD + mixed(500)
    assert token_counts.Counter(P.path("byte_bpe_50k.json")).count(texts).tolist() == [len(theirs.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_ids_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    theirs, mine = tokenizers.Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    for text in ODD + mixed(300) + ["Σίσυφος ΟΔΟΣ, ΣΑΣ.Σ İstanbul Ünï"]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_packing_plan_has_no_gaps(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 17, 64])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
    counts = {w: lengths.count(w) for w in set(lengths)}
    table, bins = packing.plan(counts, capacity), {}
    for w, n in counts.items():
        own = table[table[:, 0] == w]
        for k in range(n):
            _, first, copies, sequence, offset = own[np.searchsorted(own[:, 1], k, side="right") - 1]
            bins.setdefault(sequence + (k - first) // copies, []).append((offset + (k - first) % copies * w, w))
    for placed in bins.values():
        at = 0
        for offset, w in sorted(placed):
            assert offset == at
            at += w
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= 2 * -(-sum(lengths) // capacity)


def test_dominance_keeps_all_pieces():
    fixed, left = packing.reduce_by_dominance({7: 2, 3: 3, 9: 1, 6: 1, 5: 2}, 10)
    used = {}
    for times, pattern in fixed:
        assert sum(w * k for w, k in pattern) <= 10
        for w, k in pattern:
            used[w] = used.get(w, 0) + times * k
    assert {w: used.get(w, 0) + left.get(w, 0) for w in (7, 3, 9, 6, 5)} == {7: 2, 3: 3, 9: 1, 6: 1, 5: 2}


@pytest.mark.parametrize("size", [64, 128, 64 * 511, 64 * 512, 64 * 1100])
def test_gif_round_trip(size):
    payload = random.Random(size).randbytes(size // 2) + b"ab" * (size // 4)
    frames = gif.decode_gif(gif.encode_gif(payload))
    assert b"".join(f.colours[:, :, 0].tobytes() for f in frames) == payload
    assert [f.delay for f in frames] == [gif.DELAY] * -(-size // (64 * gif.ROWS))
    assert sum(gif.histogram(frames)) == size


def picture(disposal: int, clear: bool) -> bytes:
    """Two frames of 2 x 2 over a palette of 4: the second one draws the right column only."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    word = lambda n: n.to_bytes(2, "little")

    def frame(left: int, wide: int, codes: list[int], kind: int, see_through: bool) -> bytes:
        number = sum(c << (3 * k) for k, c in enumerate([4, *codes, 5]))
        data = number.to_bytes(-(-3 * (len(codes) + 2) // 8), "little")
        return b"\x21\xf9\x04" + bytes([kind << 2 | see_through]) + word(7) + bytes([3, 0, 0x2C]) + word(left) + word(0) + word(wide) + word(2) + b"\0\2" + bytes([len(data)]) + data + b"\0"

    return b"GIF89a" + word(2) + word(2) + b"\x81\0\0" + palette + frame(0, 1, [1, 2], disposal, False) + frame(1, 1, [3, 2], 1, clear) + b";"


def test_gif_disposal_and_transparency():
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    pixels = lambda f: [tuple(int(v) for v in p) for p in f.canvas.reshape(-1, 3)]
    first, second = gif.decode_gif(picture(1, False))
    assert pixels(first) == [red, black, green, black] and first.delay == 7
    assert pixels(second) == [red, blue, green, green]
    assert pixels(gif.decode_gif(picture(1, True))[1]) == [red, black, green, green]
    assert pixels(gif.decode_gif(picture(2, False))[1]) == [black, blue, black, green]
    with pytest.raises(ValueError):
        gif.decode_gif(b"nothing")


def longest_common(text: list[int], cap: int) -> list[int]:
    order, out = sorted(range(len(text)), key=lambda i: text[i:]), [0] * len(text)
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        out[a], out[b] = max(out[a], k), max(out[b], k)
    return out


@pytest.mark.parametrize("seed", range(120))
def test_induced_sorting(seed):
    r = random.Random(seed)
    text = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(1, 60))]
    if seed % 2:
        text += text[: len(text) // 2]
    text.append(0)
    cap = r.choice([3, 8, 60])
    assert suffixes.neighbours(np.array(text), cap, r.choice([1, 100, 1 << 20])).tolist() == longest_common(text, cap)


def test_disk_queue_keeps_order():
    queue = suffixes.DiskQueue(limit=50)
    for k in range(20):
        queue.push(k % 3, np.array([k]), np.array([k], np.uint8))
    assert queue.pop(1)[0].tolist() == [1, 4, 7, 10, 13, 16, 19]
    assert queue.pop(1)[0].tolist() == []
    queue.close()


def test_equal_windows_have_equal_anchors():
    r = random.Random(5)
    shared = bytes(r.randint(97, 122) for _ in range(400))
    a, b = (runs for runs in (repeats.runs(bytes(r.randint(97, 122) for _ in range(n)) + shared, 60) for n in (0, 333)))
    assert len(set(a[1].tolist()) & set(b[1].tolist())) > 3
    assert repeats.spans_of(np.array([5, 0, 80]), 200, 60).tolist() == [[0, 65], [80, 140]]


def test_shingles():
    sets = list(jaccard.shingle_sets(["a b c d", "A  B\tc\nD", "a b", "a b ", "", None, "a b c d a b c"], 3, b"key"))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 4]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all()
    assert jaccard.similar(sets[0], sets[1], 100) and not jaccard.similar(sets[0], sets[2], 10)


def test_balanced_parts_and_router():
    r = np.random.default_rng(0)
    rows = neighbours.unit(np.concatenate([r.normal(size=16) * 3 + r.normal(size=(60, 16)) for _ in range(8)]))
    graph = neighbours.nearest(rows, rows, 9)
    sizes = np.bincount(neighbours.balanced_parts(rows, graph, 8, r))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2
    router = neighbours.train(rows[40:], rows[:40], 8, 5)
    assert 1 <= router.open <= 8


def test_isotonic_and_statistics():
    x, y = quality.isotonic(np.arange(4.0), np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and y.tolist() == [0, 1 / 3, 1]
    stats = quality.statistics(["", None, "Good words here.\nGood words here.", "$$$ ###"])
    assert stats.shape == (4, len(quality.NAMES)) and np.isfinite(stats).all()
    assert (stats[0] == 0).all() and (stats[1] == 0).all()


def test_shards_spill_and_keep_their_order(monkeypatch):
    spilled, plain = [], suffixes.DiskQueue._spill
    monkeypatch.setattr(suffixes.DiskQueue, "_spill", lambda self: (spilled.append(self.size), plain(self)))
    r = random.Random(9)
    base = [r.randint(2, 27) for _ in range(300)]
    text = []
    for _ in range(1500):
        own = list(base)
        own[r.randrange(300)] = r.randint(2, 27)
        text += own + [1]
    text = np.array([*text, 0])
    found = suffixes.neighbours(text, 200)
    assert spilled, "an ordinary shard is larger than its queues"
    assert (found == suffixes.neighbours(text, 200, 1 << 40)).all()


def test_runs_that_a_polynomial_hash_takes_for_equal():
    first = bytes(b"an"[bin(k).count("1") & 1] for k in range(2048))
    marks = [repeats.runs(x, 60)[1].tolist() for x in (first, first.translate(bytes.maketrans(b"an", b"na")))]
    contents = [[x[a : a + n + 59] for a, n in zip(*repeats.runs(x, 60)[2:], strict=True)] for x in (first, first.translate(bytes.maketrans(b"an", b"na")))]
    by = {}
    for own, texts in zip(marks, contents, strict=True):
        for mark, text in zip(own, texts, strict=True):
            assert by.setdefault(mark, text) == text


def test_token_counts_of_pieces_that_a_polynomial_hash_takes_for_equal():
    tokenizers = pytest.importorskip("tokenizers")
    theirs, mine = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.Counter(P.path("byte_bpe_50k.json"))
    texts = []
    for a, b, n in (("a", "n", 1024), ("i", "q", 1024), ("1", "2", 2048)):
        first = "".join((a, b)[bin(k).count("1") & 1] for k in range(n))
        texts += [first, first.translate(str.maketrans(a + b, b + a)), first + " x"]
    want = [len(theirs.encode(t, add_special_tokens=False).ids) for t in texts]
    assert mine.count(texts).tolist() == want
    assert [mine.count([t])[0] for t in texts] == want and mine.count(texts[::-1]).tolist() == want[::-1]


def test_remembered_pieces_are_compared():
    mine = token_counts.Counter(P.path("byte_bpe_50k.json"))
    mine.code[:] = 1  # now all pieces of one length have one hash
    texts = ["hello there general", "aaaaa bbbbb zzzzzzz", "hello"] + ODD
    plain = token_counts.Counter(P.path("byte_bpe_50k.json")).count(texts).tolist()
    assert mine.count(texts).tolist() == plain and mine.count(texts).tolist() == plain
