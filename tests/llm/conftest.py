import random

import pytest

WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "ne", "pa", "ro", "su", "ti") for b in ("la", "mer", "nos", "rix", "ton", "vel", "wan", "zed")]


def prose(rng, n, words=WORDS):
    out = []
    for i in range(n):
        out.append(rng.choice(words) + rng.choice(words) * rng.randint(0, 1))
        if i % 12 == 11:
            out[-1] += ".\n" if rng.random() < 0.5 else "."
    return " ".join(out)


def corpus(seed=5):
    """(doc_id, text) with exact copies, near copies, shared passages and lines, and every odd case."""
    rng = random.Random(seed)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    base = [prose(rng, rng.randint(40, 200)) for _ in range(14)]
    passage, line = prose(rng, 60).replace("\n", " "), "A line that many documents share, long enough to count."
    for b in base:
        add(b)
    for b in base[:4]:
        add(b)
        add(b)
        for k in range(4):
            w = b.split(" ")
            for _ in range(1 + 2 * k):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            add(" ".join(w))
    for b in base[5:10]:
        add(b + " " + passage + " " + prose(rng, 30))
        add(line + "\n" + prose(rng, 30) + "\n" + line.replace("many", "some") + "\n\n" + line.upper())
    add(None)
    add("")
    add(" \t\n \r\n")
    add("one")
    add("two words")
    add("Two WORDS")
    add("de " * 90)
    add("\n" * 5)
    add("é日本🙂 <|endoftext|> İstanbul ΣΑΣ 'S don't 42nd\x85x y " * 3)
    add("x" * 3000)
    add(" ".join(base) * 2)
    rows.append((None, base[0]))
    rows.append((None, None))
    rows.append((rows[3][0], rows[3][1]))
    return rows


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


EXTRA = ", r bigint, lines string, key string, n_lines int, rate double, copy int, next_text string, fp string, component_id string, spans string, toxic_score string, media string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """Tables with nulls in every column, odd texts, repeated rows and columns whose names operators use."""
    path = str(tmp_path_factory.mktemp("tables"))
    full = [(i, t, None if k % 7 == 3 else "en", None if k % 9 == 4 else f"s{min(k % 5, 2)}", None if t is None else len(t)) + (None,) * 12 for k, (i, t) in enumerate(rows)]
    write(spark, path, "documents", full, "doc_id bigint, text string, lang string, source string, n_chars bigint" + EXTRA)
    labels = [(i, None if k % 11 == 5 else k % 2, None if k % 13 == 6 else int(k % 3 == 0)) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (1, 0, 0), (99999, 1, 0)]
    write(spark, path, "labels", labels, "doc_id bigint, quality int, toxic int")
    html = [t for _, t in rows]
    pages = [(i if i != 7 else 6, f"https://{'' if i % 3 else 'www.'}host{i % 4}.example.org:8080/p/{i % 9}?q={i % 2}#f" if i % 8 else None, html[i % len(html)]) for i in range(70)] + [(None, "http://a.b/", "y" * 200), (500, "HTTP://User@A.B/x", "y" * 200), (501, "no url", "y" * 200)]
    write(spark, path, "pages", pages, "page_id bigint, url string, html string")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    write(spark, path, "documents", [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write(spark, path, "labels", [], "doc_id bigint, quality int, toxic int")
    write(spark, path, "pages", [], "page_id bigint, url string, html string")
    return path
