"""Blocks of lines that are short each, and of scripts without spaces."""

from __future__ import annotations

from tests.llm.test_lines_partners import brute, removed


def test_blocks_of_short_lines_and_unspaced_scripts_go(spark):
    verse = "o rose\nthou art\nsick the\nworm"
    chinese = "今天天气很好我们去公园\n花开了\n鸟在唱歌"
    texts = [verse, "before it\n" + verse, chinese, chinese, "好\n" + chinese, "花开了", "two words", "two words"]
    want = brute(texts)
    assert want == [0, 4, 0, 3, 3, 0, 0, 0]
    assert removed(spark, texts) == want
