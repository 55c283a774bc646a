"""Support and confidence alone bound the mined rules."""

import itertools

from polysafe.llm import urls


def test_every_rule_above_support_and_confidence_is_kept(spark):
    names = ["".join(x) for x in itertools.islice(itertools.product("abcdefgh", repeat=3), 300)]
    rows = [("http://same.example/" + "/".join(names[3 * g:3 * g + 3]) + "/end", "block" if g % 2 else "allow") for g in range(100) for _ in range(2)]
    got = urls.mine_rules(spark.createDataFrame(rows, "url string, label string"), min_support=0.01)
    assert {r.tokens for r in got} == {(f"path:{n}",) for n in names}
