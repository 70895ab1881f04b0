import random
import time

import numpy as np
import pytest

from rankloom.llm import language, markup
from rankloom.llm.gru import ByteGru

PLAIN = [
    None, "", "  ", "The bill rose from $74 to $546 last month.", "Retry if depth < 38 and age > 3, rc == 0 && size >= 473.", "It returns Map<String, List<Integer>> for a.",
    "Run restore --job <job-name> --limit <count> <title> now.", "Copy D:\\exports\\briirta\\new to the share.", "Set max_file_count in x_tmp_dir [draft] (see memo), a[8][0].",
    "- one\n- two\n* three\n1. four\n  indented", "[10:20] u509: hello\n[10:21] u1: yes", "Arrow -> means, => means, and ... means open. #4207 ~22 {x, y} a|b", "R&D; AT&T, 4 * 10 * 3, 2**3**4 __init__",
]
MARKED = [
    ("<p>Hello <b>world</b></p>", ["html"], "Hello world"), ("Fish &amp; chips&nbsp;now", ["html"], "Fish & chips now"), ("a<br/>b", ["html"], "a\nb"), ("<!-- x -->Text", ["html"], "Text"),
    ("<h2>Head</h2><ul><li>a</li><li>b</li></ul><pre><code>if a &lt; b:\n  c</code></pre>", ["html"], "## Head\n\n- a\n- b\n\n```\nif a < b:\n  c\n```"),
    ("## Head\n\nText with `code` and **bold**, ~~gone~~ [link](http://x.y).", ["markdown"], "## Head\n\nText with code and bold, gone link."),
    ("Head\n====\n\n- [ ] task\n- [x] done", ["markdown"], "# Head\n\n- task\n- done"), ("```sh\nls <b> $HOME\n```", ["markdown"], "```sh\nls <b> $HOME\n```"),
    ("| a | b |\n|---|---:|\n| 1 | 2 |", ["markdown"], "| a | b |\n| 1 | 2 |"), ("![alt](img/a.png) end", ["markdown"], "alt end"),
    ("== Head ==\n\n'''bold''' and ''it'' [[Page|text]] [[Other]]\n\n[[Category:X]]", ["wiki"], "## Head\n\nbold and it text Other"), ("{{Notice|team=A}}\n\nText", ["wiki"], "Text"),
    ("{| class=\"wikitable\"\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"], "| a | b |\n| 1 | 2 |"), ("[[Link]] first\n\n** deep\n: in", ["wiki"], "Link first\n\n  - deep\n- in"),
    ("\\section{Head}\n\n\\textbf{bold} 15\\% and $q_i^{2} \\le 5$.", ["latex"], "# Head\n\nbold 15% and $q_i^{2} \\le 5$."),
    ("\\begin{itemize}\n  \\item a\n  \\item b\n\\end{itemize}", ["latex"], "- a\n- b"), ("So\n\\[ t = \\frac{1}{2} \\]\nend", ["latex"], "So\n\n$ t = \\frac{1}{2} $\n\nend"),
    ("<em>a</em> and **b**", ["html", "markdown"], "a and b"),
    ("<p>Seen</p><style>.a{color:red}</style><script type='x'>var x=1 && '<b>';</script><p>too</p>", ["html"], "Seen\n\ntoo"),
    ("<ol><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ol><h4>Deep</h4>", ["html"], "1. a\n  - b\n  - c\n2. d\n\n#### Deep"),
    ("<pre><code class=\"language-python\">x = 1</code></pre>", ["html"], "```python\nx = 1\n```"),
    ("# One\n\n### Three\n\n1. a\n2. b\n   - c\n10) d", ["markdown"], "# One\n\n### Three\n\n1. a\n2. b\n  - c\n10) d"),
    ("Head\n----\n\nBody", ["markdown"], "## Head\n\nBody"),
    ("=== Head ===\n\n*** c\n\nSee [[Page]].", ["wiki"], "### Head\n\n    - c\n\nSee Page."),
    ("\\subsection{Sub}\n\\begin{enumerate}\n\\item a\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\item c\n\\end{enumerate}", ["latex"], "## Sub\n\n1. a\n  - b\n2. c"),
    ("\\begin{lstlisting}[language=Java]\nint x;\n\\end{lstlisting}", ["latex"], "```java\nint x;\n```"),
]


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert markup.Cleaner()(text)[0] == []


@pytest.mark.parametrize("text, kinds, clean", MARKED)
def test_markup(text, kinds, clean):
    got = markup.Cleaner()(text)
    assert got[0] == kinds and got[1] == clean


def test_link_lists_are_residue():
    nav = "\n\n".join(f"[Products overview page {i}](p{i}.html)" for i in range(4))
    body = "The committee of the board met in the office and it was decided that the plan is not to be changed before the end of the year."
    kinds, clean, blocks, dropped = markup.Cleaner()(f"{nav}\n\n{body}\n\nShort line")
    assert kinds == ["markdown"] and clean == f"{body}\n\nShort line" and (blocks, dropped) == (6, 4)


def test_inheritance_is_linear():
    clean, text = markup.Cleaner(), "[[Page]] first\n\n" + "> short\n\n# maybe\n\n" * 6000
    began = time.time()
    kinds, _, blocks, _ = clean(text)
    assert kinds == ["markdown", "wiki"] or kinds == ["wiki"]
    assert blocks == 12_001 and time.time() - began < 20


def test_stop_words_of_the_corpus(spark):
    rng = random.Random(2)
    data = [(i, " ".join(["the", "of", *rng.choices([f"w{chr(97 + j)}" for j in range(26)], k=3), f"x{i}"]), "en") for i in range(60)]
    data += [(100 + i, "der Bericht und " + rng.choice("abcdefg") * 3, "DE_at") for i in range(30)] + [(200 + i, "这是" + rng.choice("山水火土木金") * 2, "zh") for i in range(30)]
    data += [(300, "odd odd", "it"), (301, None, "en"), (302, "", None)]
    words, han = markup.stop_words(spark.createDataFrame(data, "id int, text string, lang string"), "text", "lang", share=0.6)
    assert words == {"the", "of", "der", "bericht", "und"} and han == {"这", "是"}


def test_long_and_odd_texts_end():
    clean = markup.Cleaner()
    for text in ("<" * 20000, "[" * 20000, "**" * 10000, "$" * 20001, "\\item{" * 5000, "`" * 9999, "word " * 60000, "| " * 8000, "\ue0000\ue001 x", "{{" * 9000, "&" * 9000):
        clean(text)


def test_clean_table(spark, rows):
    df = spark.createDataFrame([("a", "<p>x</p>", 1), ("b", None, 2), (None, "**x**", 3), ("c", "**x** <i>y</i>", 4), ("c", "**x** <i>y</i>", 4)], "id string, text string, kinds int")
    cleaned = markup.clean_markup(df, "id", "text")
    assert cleaned.count() == 4
    assert rows(markup.markup_kinds(cleaned, "id")) == [("a", "html"), ("c", "html"), ("c", "markdown")]
    assert markup.clean_markup(df.limit(0), "id", "text").count() == 0


def test_gradients():
    net = ByteGru(3, hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(1, 255, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 0]), np.ones((4, 6))
    _, grad = net.gradients(x, y, w)
    for name, at in (("inner", (0, 1, 2)), ("inner", (1, 2, 8)), ("table", (0, x[0, 0], 7)), ("table", (1, x[1, 3], 1)), ("out", (2, 1)), ("bias", (0,))):
        net.w[name][at] += 1e-3
        up = net.gradients(x, y, w)[0]
        net.w[name][at] -= 2e-3
        down = net.gradients(x, y, w)[0]
        net.w[name][at] += 1e-3
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-5)


def test_windows_cover_every_byte_once():
    for n in (0, 1, 79, 80, 81, 500):
        data = np.arange(1, n + 1).astype(np.uint8)
        views = language.windows_of(data)
        inner = views[:, language.EDGE : -language.EDGE].reshape(-1)[:n]
        assert (inner == data).all()


def test_passages():
    text = "A first sentence that is long. Tiny. 第二句话写在这里,并且足够长。Another line here\nlast"
    cut = language.passages(text)
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    assert language.passages("") == [] and language.passages("x") == [(0, 1)]


# Words of three made-up languages, so that the test needs no corpus.
WORDS = {"en": "the house was built with stone and they said that which there".split(), "de": "das haus wurde aus stein gebaut und sie sagten dass welche dort".split(), "zh": list("房子是用石头建的他们说那里有什么")}


def sentence(rng, lang, n=9):
    return ("" if lang == "zh" else " ").join(rng.choices(WORDS[lang], k=n if lang != "zh" else 14)) + ("。" if lang == "zh" else ". ")


def test_languages_of_texts(spark):
    rng = random.Random(1)
    data, truth = [], {}
    for i in range(240):
        lang = rng.choice(list(WORDS))
        body = "".join(sentence(rng, lang) for _ in range(4))
        label = lang if i % 8 else rng.choice(["de", None, "xx", "en"])
        data.append((i, body.upper() if i % 7 == 0 else body, label, "s"))
        truth[i] = {lang}
    for i in range(240, 260):
        data.append((i, "".join(sentence(rng, "en") for _ in range(3)) + "\n" + "".join(sentence(rng, "de") for _ in range(3)), "English", "s"))
        truth[i] = {"en", "de"}
    data += [(260, "12 33 4.5\n99", "en", "s"), (261, None, "en", "s"), (262, "", None, "s"), (None, "x y", "en", "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, language string")
    found = language.segments(docs, "doc_id", "text", "lang", sample=60).cache()
    assert {r["doc_id"] for r in found.filter("language is null").collect()} == {260}
    got = {}
    for r in language.shares(found, "doc_id").collect():
        assert 0 < r["share"] <= 1 and 0 < r["confidence"] <= 1
        if r["share"] >= 0.2:
            got.setdefault(r["doc_id"], set()).add(r["language"])
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.97 * len(truth)
    wrong = {(r["doc_id"], r["lang_found"]) for r in language.unstated(docs, language.shares(found, "doc_id"), "doc_id", "lang").collect()}
    assert sum((i, "de") in wrong and (i, "en") not in wrong for i in range(240, 260)) >= 18
    covered = {r["doc_id"]: (r["a"], r["b"]) for r in found.groupBy("doc_id").agg({"start": "min", "end": "max"}).withColumnRenamed("min(start)", "a").withColumnRenamed("max(end)", "b").collect()}
    assert all(covered[i] == (0, len(t)) for i, t, _, _ in data if i is not None and t)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "def", "xx")], "doc_id long, text string, lang string")
    assert language.segments(docs, "doc_id", "text", "lang").count() == 0


def test_long_texts_are_labelled_whole(monkeypatch):
    net = ByteGru(2, hidden=4)
    texts = ["Ein langer Satz mit Ümlauten. " * 90 + "第二句话。" * 120, "short", "", "x" * 3000 + ". yes no\n" * 5]
    want = language.Labeller(net, ["a", "b"])(texts)
    assert want[0][0][0] == 0 and want[0][-1][1] == len(texts[0]) and all(x[1] == y[0] and x[2] != y[2] for x, y in zip(want[0], want[0][1:], strict=False))
    assert [f[:2] for f in want[1]] == [(0, 5)] and want[2] == []
    for windows in (1, 2, 7):
        monkeypatch.setattr(language, "WINDOWS", windows)
        got = language.Labeller(net, ["a", "b"])(texts)
        assert [[f[:3] for f in t] for t in got] == [[f[:3] for f in t] for t in want]


def test_deeply_nested_latex():
    text = "see the word"
    for name in ("emph", "textbf", "Large", "underline", "mbox", "textit", "LARGE", "emph"):
        text = f"\\{name}{{{text}}}"
    kinds, clean, _, _ = markup.Cleaner()(f"Here we {text} in the middle of a sentence that is long enough.")
    assert kinds == ["latex"] and clean == "Here we see the word in the middle of a sentence that is long enough."
