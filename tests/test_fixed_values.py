"""Values that decide results, spelled out once apart from the code: twins in SQL share the operators' own."""

import re

from folioscope.functions import text as T
from folioscope.operators import brief as B
from folioscope.operators import sections as S


def test_major_titles():
    whole = "prospectus summary, summary, risk factors, use of proceeds, dividend policy, capitalization, dilution, selected financial data, summary financial data, business, management, principal stockholders, description of capital stock, shares eligible for future sale, underwriting"
    start = "managements discussion and analysis, certain relationships and related, material us federal income tax"
    assert all(re.search(S.MAJOR, t) and not re.search(S.MAJOR, t + " x") and not re.search(S.MAJOR, "x " + t) for t in whole.split(", "))
    assert all(re.search(S.MAJOR, t) and re.search(S.MAJOR, t + " x") and not re.search(S.MAJOR, "x " + t) for t in start.split(", "))


def test_risk_words_and_fragments():
    for word in "could may might adversely materially harm fail unable risk uncertain loss decline negativ delay disrupt litigation breach violat depend prevent impair".split() + ["subject to"]:
        assert re.search(T.RISK_SIGNAL, f"we {word.upper()} x")
    assert not re.search(T.RISK_SIGNAL, "sales grow every year")
    fragments = ["CEO, our head, left", "Moreover, sales fell", "Such losses grow", "Acme (or the Company) sells", "it) grew", "The plan, which failed", "x, and such persons", "as such allegations", "the foregoing", "Additional risks", "If any of the following risks occur"]
    assert all(any(re.search(p, t) for p in T.FRAGMENTS) for t in fragments)
    assert not any(re.search(p, "Our sales could decline in any market we serve") for p in T.FRAGMENTS)
    assert all(re.fullmatch(T.ABBREVIATIONS, a) for a in "Mr Mrs Ms Dr Jr Sr St Inc Co Corp Ltd No vs e.g i.e A".split()) and not re.fullmatch(T.ABBREVIATIONS, "etc")


def test_routes_and_groups():
    assert [(t, s, n) for t, s, _, n in B.ROUTES[:-1]] == [
        ("business", "what-it-does", 12), ("offering", "offering-mechanics", 12), ("financial", "financial-snapshot", 20), ("proceeds", "use-of-proceeds", 8), ("dilution", "dilution-capitalization", 10),
        ("governance", "control-governance", 14), ("debt", "debt-liquidity", 12), ("related_party", "related-party-transactions", 12), ("lockup", "lockup-share-overhang", 8),
    ]
    assert B.ROUTES[-1][:2] == ("risk", "key-risk-themes") and [r[2] for r in B.ROUTES] == list(range(1, 11))
    assert [g for g, _, _ in B.READER_GROUPS] == ["overview", "offering", "financials", "ownership", "capital", "risks"] and sum(len(s) for _, _, s in B.READER_GROUPS) == 10
    assert all(re.search(B.REAL_VALUE, x) for x in ("$ 5", "$1.2", "( 7", "12,000 million", "3.5%", "4 billion")) and not re.search(B.REAL_VALUE, "12 shares")
