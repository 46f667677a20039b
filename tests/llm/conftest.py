"""A small corpus with every odd case, as the tables the queries read."""

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and to in for on with as river stone light paper window garden music winter café straße año".split()
NOTICE = "This work is licensed under the GNU General Public License, version 3."


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out, sentence = [], 0
    for i in range(n):
        word = rng.choice(WORDS) + rng.choice(["", "", "s", "ly", str(rng.randint(0, 99))])
        sentence += 1
        if sentence > 8 and rng.random() < 0.3:
            word, sentence = word + rng.choice([".", ".\n", "!", "?"]), 0
        out.append(word)
    return " ".join(out).replace("\n ", "\n")


def rows() -> list[tuple]:
    passage = prose(900, 60) + "."
    texts = [prose(i, 40 + 17 * i) for i in range(30)]
    texts += [texts[3], texts[3], texts[4].replace("river", "rivers", 1)]  # copies and a near copy
    texts += [prose(40 + i, 60) + ".\n" + passage + " " + prose(60 + i, 30) for i in range(4)]
    texts += [None, "", " \n\t", "one", "two words", "?!", "\x1c odd \x85 spaces \xa0", "İstanbul İİ", "x" * 5000]
    texts += [prose(70, 80) + ". " + item for item in items() if item]
    texts += [NOTICE + " " + prose(80, 60), "ALL CAPS AND LOUD! " * 40, "a b c d " * 60]
    texts += [prose(99, 30_000)]  # a very long one
    langs = ["en", "de", None]
    out = [(i, t, langs[i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[5], out[6], (7, "another text of a repeated key", "en", None, None), (None, prose(5, 90), "en", "s", 1)]


def items() -> list[str | None]:
    return [prose(500, 25), prose(501, 12), "five words make an item", None, "", prose(501, 12)]


def documents(data: list[tuple]) -> pa.Table:
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*data, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def urls() -> list[str | None]:
    return [
        "http://www.Example.com/en/1?x", "https://blog.river.example.com/en/2#top", "http://a.example.net/es/3",
        "http://net/fr/", "http://stonegarden.example.org/en/paper", "https://free-bets.example.org/de/9.html",
        "http://example.com", "http://example.com?x=/en/", "no scheme", "", None, "x://", "http://EXAMPLE.COM/de/",
        "http://windowlight.example.org/x?y", "http://windowlight.example.org/x?y",
    ]


@pytest.fixture(scope="session")
def corpus(tmp_path_factory):
    """Paths of the tables by name: full, and without any row."""
    out = {}
    for name in ("full", "empty"):
        path = tmp_path_factory.mktemp(name)
        full = name == "full"
        data = rows() if full else []
        pq.write_table(documents(data), path / "documents.parquet")
        bench = list(enumerate(items())) if full else []
        pq.write_table(
            pa.table({"item_id": pa.array([i for i, _ in bench], pa.int64()), "text": pa.array([t for _, t in bench], pa.string())}),
            path / "benchmark.parquet",
        )
        labelled = [(r[0], 1, 0) for r in data[:30]] + [(r[0], 0, 0) for r in data[-8:]] + [(None, 1, 0), (3, None, 0)]
        labelled = labelled if full else []
        pq.write_table(
            pa.table({n: pa.array([x[i] for x in labelled], k) for i, (n, k) in enumerate(
                [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])}),
            path / "labels.parquet",
        )
        pages = [(i, u, "<p>stone garden window light paper " + prose(i, 50)) for i, u in enumerate(urls())] if full else []
        pages += [(2, None, None)] if full else []
        pq.write_table(
            pa.table({n: pa.array([x[i] for x in pages], k) for i, (n, k) in enumerate(
                [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])}),
            path / "pages.parquet",
        )
        vectors = [(i, [((i * 7 + j * 3) % 11 - 5) / 20.0 for j in range(8)], i % 3) for i in range(40)] if full else []
        vectors += [(40, None, 0), (41, [0.1, None] + [0.0] * 6, 1), (42, [float("nan")] * 8, 2), (3, vectors[3][1], 0)] if full else []
        pq.write_table(
            pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()),
                      "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())),
                      "label": pa.array([v[2] for v in vectors], pa.int32())}),
            path / "embeddings.parquet",
        )
        out[name] = str(path)
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def as_rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
