"""A whole risk card, spelled out."""

from folioscope.operators import brief as B

TITLE = "Our growth may decline and harm sales of many kinds over the years."
BODY = f"{TITLE} We could lose sales in every market that we serve because rivals have cheaper goods and more stores. Nothing else is sure. If sales decline, our losses may grow and we might be unable to pay what we owe to our lenders on time."


def test_one_risk_becomes_one_card(spark):
    kind = "id string, document_id string, pos int, title string, original_text string, specificity string, risk_extraction_type string, source_chunk_ids array<string>"
    risks = spark.createDataFrame([("r1", "d", 1, TITLE[:-1], BODY, "mixed", "full_text", ["c1"]), ("r2", "d", 2, TITLE[:-1], BODY, "mixed", "fragment", ["c1"]), ("r3", "d", 3, TITLE[:-1], BODY, "mixed", "full_text", ["c9"])], kind)
    chunks = spark.createDataFrame([("c1", "s1", "d", "RISK FACTORS", BODY), ("c9", "s9", "d", "Business", BODY)], "id string, section_id string, document_id string, title string, text string")
    policy = spark.createDataFrame([("risk", ["Risk Factors"])], "topic string, allowed_titles array<string>")
    accepted, rejected = B.risk_cards(risks, chunks, policy, [("demand", r"\bsales\b")], r"\b(market|rivals)\b", [("the demand for goods", r"\bsales\b")], {"demand": "Fewer buyers mean less cash.", "other": "x"})
    one = "We could lose sales in every market that we serve because rivals have cheaper goods and more stores."
    two = "If sales decline, our losses may grow and we might be unable to pay what we owe to our lenders on time."
    assert rejected.count() == 0 and [r.asDict() for r in accepted.collect()] == [
        {
            "id": "evidence-risk-our-growth-may-decline-and-harm-sales-of-many-kinds-over-the-years", "card_pos": 1, "topic": "risk", "title": TITLE, "source_section_id": "s1", "source_chunk_ids": ["c1"], "source_quote": BODY, "extracted_text": BODY,
            "plain_english": f'This risk concerns the demand for goods. The filing states: "{one}" It adds: "{two}"',
            "why_it_matters": "Tied to the demand for goods, this is one of the risks the company says could materially affect its business. Fewer buyers mean less cash.",
            "confidence": "medium", "needs_review": False, "extraction_method": "risk-full-text-demand", "quality_warnings": [],
        }
    ]
