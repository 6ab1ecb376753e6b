"""Texts and sessions at their extremes: very long white space, and where intermediate tables may lie."""

import pytest
from tokenizers import Tokenizer

from quillon.llm import packing, scratch

SPACES = {"spaces": " ", "newlines": "\n", "tabs": "\t", "no-break spaces": "\u00a0", "mixed": " \n\u2003"}


@pytest.mark.parametrize("kind", sorted(SPACES))
@pytest.mark.parametrize("around", [("", ""), ("word", "word"), (" a ", "")])
def test_long_white_space_encodes_as_the_library_does(kind, around):
    text = around[0] + SPACES[kind] * (1_200_000 // len(SPACES[kind])) + around[1]
    path = packing.default_tokenizer()
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_long_words_and_runs_below_the_limit_too():
    path = packing.default_tokenizer()
    encode, library = packing.encoder(path), Tokenizer.from_file(path)
    for text in ("a" * 300_000, " " * (packing.LONG_SPACE - 1), "x" + "\n" * packing.LONG_SPACE, "!" * 300_000, ("\t" * 999 + "y") * 300):
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    rows = [(1, " " * 1_200_000), (2, "a" + "\n" * 1_200_000 + "b"), (None, None), (3, ""), (3, "")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    encode = packing.encoder(packing.default_tokenizer())
    want = sorted(len(encode(t or "")) + 1 for _, t in rows)
    assert sorted(r.doc_tokens for r in got if r.start == 0) == want and sum(r.length for r in got) == sum(want)


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, name, default=None):
        return self.value if name == "spark.checkpoint.dir" and self.value else default


class Session:
    """What shared_dir asks of a session."""

    def __init__(self, configured=None, checkpoint=None, master="spark://host:7077"):
        self.conf = Conf(configured)
        self.sparkContext = type("Context", (), {"getCheckpointDir": lambda _: checkpoint, "master": master, "applicationId": f"app-{master}"})()


def test_shared_folder():
    assert scratch.shared_dir(Session("hdfs://n/c", "hdfs://n/d", "local[2]")) == "hdfs://n/c"
    assert scratch.shared_dir(Session(None, "hdfs://n/d", "local[2]")) == "hdfs://n/d"
    own = scratch.shared_dir(Session(master="local[*]"))
    assert own.startswith("file:///") and scratch.shared_dir(Session(master="local[*]")) == own
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            scratch.shared_dir(Session(master=master))
