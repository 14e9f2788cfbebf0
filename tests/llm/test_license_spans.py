"""Every planted notice of a window is found, in whatever order their edits come."""

import itertools

from verigrain.llm.licenses import NOTICES, NoticeSearch


def test_notices_close_to_each_other():
    search = NoticeSearch()
    mit = next(k for k, n in enumerate(NOTICES) if n.words == "mit license")
    gpl = next(k for k, n in enumerate(NOTICES) if n.words == "gnu general public license")
    for k, forms in ((mit, ("mit license", "mit licence")), (gpl, ("gnu general public license", "gnu general public licence", "gnu generel public licence"))):
        for count in (2, 3, 4):
            for planted in itertools.product(enumerate(forms), repeat=count):
                wanted, at = [], 0
                for edits, words in planted:
                    wanted.append((k, at, at + len(words), edits))
                    at += len(words) + 1
                found = search.find(" ".join(words for _, words in planted) + " x")
                assert [f for f in found if f[0] == k] == wanted


def test_many_notices_in_one_window():
    found = NoticeSearch().find("mit licence " * 200 + "mit license")
    assert [f[3] for f in found if NOTICES[f[0]].words == "mit license"] == [1] * 200 + [0]
