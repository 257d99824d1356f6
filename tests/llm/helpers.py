"""Small documents with every awkward case, and brute-force counterparts of the operators."""

import hashlib
import re

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000


def awkward_documents(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", "b"), (4, None, "en", "a"), (5, "", None, None),
        (6, " \t\n ", "fr", "b"), (None, base, "fr", "b"), (None, None, None, None), (7, "one two", "fr", "c"), (8, "One\ttwo", "fr", "c"),
        (9, LONG, "de", "c"), (10, "12345 !!! ???", "de", None), (11, base + " nu", "de", "a"), (12, "😀 ▁ naïve café x" * 3, "fr", "d"), (13, "\x00nul  nbsp em", "fr", "d"),
    ]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)


CLASHES = """size ids spans keys digest key rank _shard quota score _found n u v id comp label2 lang_pred held_out bits_per_byte taken target full cut_from
    cut_words source_size _row _name _rows _cut _part text_u class component_id kept n_tokens""".split() + ["a b", "a.b", "a`b"]


def with_clashes(df):
    """Columns that operators use inside, under names they use, and odd names."""
    for name in CLASHES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
