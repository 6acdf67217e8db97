import pytest

from folioframe.llm.common import prepare

EXTRA = "rid key h c n uid band bands text_hash tokens p rate copies lang_pred score rejected _text _id leaves edits row id hash total".split()


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in any column, empty, odd and long texts, repeated rows and ids, and extra columns with names the operators use."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    base = " ".join(words[(i * 7 + i // 3) % 20] + str(i % 11) for i in range(120))
    near = base.replace("gamma", "other", 1)
    texts = [(1, base), (2, near), (3, base), (3, base), (4, None), (None, base), (None, None), (5, ""), (6, " \n\t"), (7, "### $$$"), (8, "x"), (9, "x"),
             (10, base + "\n"), (11, "日本語 テキスト " * 20), (12, "word " * 40000), (13, "a\x00b\x1cc"), (14, "Ab" * 30000), (5, ""), (15, "  nb"), (16, near + " end")]
    rows = [(d, t, "en" if i % 3 else None, f"s{i}" if i % 4 else None, None if t is None else len(t)) for i, (d, t) in enumerate(texts)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in EXTRA:
        df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
