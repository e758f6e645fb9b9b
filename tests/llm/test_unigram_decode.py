"""Decoding many rows of ids at once equals decoding them one by one."""

import random

import pyarrow as pa
import public_tokenizers

from merchframe.llm import unigram


def test_lists_decode_like_single_rows():
    model = unigram.Model.get(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(3)
    texts = ["", "plain words", "  two  blanks ", "日本語 кириллица 🙂\x00\n\t", "x" * 300]
    rows = [list(memoryview(model.wholes(["▁" + t.replace(" ", "▁") if t else ""])[0]).cast("i")) for t in texts]
    plain = [i for i, name in enumerate(model.names) if name is not None]
    rows += [[r.choice(plain) for _ in range(r.randint(0, 30))] for _ in range(40)]
    for some in (rows, rows + [[model.byte_ids[0xFF], model.byte_ids[0xE2], *rows[1]]]):  # the last isn't UTF-8
        for at in (0, 3):
            ids = pa.array(some, pa.list_(pa.int32())).slice(at)
            first = [k % 3 > 0 for k in range(len(ids))]
            got = model.decode_lists(ids, pa.array(first)).to_pylist()
            assert got == [model.decode(i, f) for i, f in zip(some[at:], first)]
    assert model.decode_lists(pa.array(rows[:5], pa.list_(pa.int32())), pa.array([True] * 5)).to_pylist() == texts


def test_chunk_matrices_choose_as_whole_texts():
    """Matrices leave out what lies between safe cuts, without segmenting it; all pieces stay those of the whole text."""
    model = unigram.Model.get(public_tokenizers.path("piece_bpe_32k.model"))
    r, n = random.Random(4), model.longest
    words = ["alpha", "beta", "x" * 90, "日本語", "", "", "don't", "12.5%", "🙂"]
    for k in range(30):
        text = "▁" + "▁".join(r.choice(words) for _ in range(400))
        size = r.choice((2 * n, 3 * n + 1, 200))
        chunks = [text[at:at + size] for at in range(0, len(text), size)]
        after = [*(c[:n - 1] for c in chunks[1:]), ""]
        for c, a in zip(chunks, after):
            cuts = [m.start() for m in model.border.finditer(c + a) if n <= m.start() <= len(c)]
            assert model.borders(c + a, len(c)) == ((cuts[0], cuts[-1]) if cuts else None)
        model.known.clear()
        own = [model.transfer(c + a, len(c)) for c, a in zip(chunks, after)]
        assert not model.known
        heads = [[0.0 if j == 0 else float("-inf") for j in range(n)]]
        for m in own:
            heads.append((m.T + heads[-1]).max(axis=1))
        states = [0]
        for m, head in zip(reversed(own), reversed(heads[:-1])):
            states.append(int((m[:, states[-1]] + head).argmax()))
        states.reverse()
        got = b"".join(model.chunk(c + a, len(c), j, k) for c, a, j, k in zip(chunks, after, states, states[1:]))
        assert sum(map(model_score(model), memoryview(got).cast("i"))) == sum(
            map(model_score(model), memoryview(model.wholes([text])[0]).cast("i")))
        assert "".join(model.decode(memoryview(got).cast("i").tolist(), False)) == text.replace("▁", " ")


def model_score(model):
    scores = {i: s for i, s in model.pieces.values()}
    return lambda i: scores.get(i, 0)
