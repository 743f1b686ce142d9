"""The edit budget of benchmark items is the stated rate of their characters."""

from __future__ import annotations

import random

from stepledger.llm import decontamination as D


def test_passages_edited_within_the_rate_are_found(spark):
    rng = random.Random(3)
    items, docs, expected = [], [], set()
    for number, n in enumerate((13, 25, 31, 47, 81, 100, 233, 339)):
        item = D.normal("".join(rng.choices("abcdefghijklm", k=n)))
        edits = int(0.08 * n)
        places = [round((k + 0.5) * n / edits) for k in range(edits)]
        passage = "".join("z" if k in places else c for k, c in enumerate(item))
        items.append((number, item))
        docs += [(2 * number, f"before {passage} after"), (2 * number + 1, f"before {passage.replace(passage[1], 'zz', 1)[::-1]} after")]
        expected.add((2 * number, number, edits))
    assert [D.budget(n) for n in (5, 13, 31, 47, 81, 233, 339)] == [0, 1, 2, 3, 6, 18, 27]
    found = D.contaminations(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {tuple(r) for r in found.collect()} == expected
