"""What a customer writes about an order, what evidence is described, and why a decision was taken.

Texts are projections of the facts: one template a claim, one sentence a base outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators import layout

#: Fixed values, down to DIFFICULT: facts of the difficult cases, as changes of one base; kinds of goods set their own flags.
COMMON = dict(product_type="clothing", days_since_delivery=3, is_used=False, is_resellable=True, has_quality_issue=False, has_evidence=False, order_amount=199, refund_count_30d=0, user_claim="no_reason", order_status="delivered", seller_fault=False, logistics_issue=False, evidence_conflict=False, order_info_conflict=False)
_FAULTY = dict(has_quality_issue=True, has_evidence=True, seller_fault=True, user_claim="quality_issue")
DIFFICULT = [
    dict(product_type="clothing"), dict(product_type="fresh"), dict(product_type="customized"), dict(product_type="virtual"), dict(days_since_delivery=9, user_claim="size_not_fit"),
    dict(product_type="electronics", has_quality_issue=True, has_evidence=True, user_claim="quality_issue"), dict(product_type="electronics", has_quality_issue=True, user_claim="quality_issue"),
    dict(order_amount=2499), dict(product_type="home", refund_count_30d=4), dict(is_used=True, is_resellable=False, user_claim="claims_unused_but_used"),
    dict(product_type="fresh", **_FAULTY), dict(product_type="customized", **_FAULTY), dict(product_type="virtual", **_FAULTY),
    dict(product_type="electronics", has_quality_issue=True, user_claim="strong_complaint"), dict(product_type="electronics", has_quality_issue=True, has_evidence=True, evidence_conflict=True, user_claim="strong_complaint"),
    dict(user_claim="exchange"), dict(product_type="home", logistics_issue=True, seller_fault=True, has_evidence=True, user_claim="logistics_issue", order_status="not_delivered"),
]
GOODS = {"clothing": "a jacket", "electronics": "headphones", "home": "a shelf", "fresh": "a fruit box", "customized": "an engraved mug", "virtual": "a membership"}
#: Requests by claim; {g} is the goods, {d} how long they have been there. Without a reason one of three is drawn.
ASKS = {
    "exchange": "Could I swap {g} for another size? It is {d}.", "size_not_fit": "It is {d}: {g}, and it does not fit. Please take it back.", "quality_issue": "I have {g}, {d}, and something is broken.",
    "logistics_issue": "Where is my order of {g}? The parcel never reached me.", "claims_unused_but_used": "I want to return {g}. It is as new, I have not touched it.", "strong_complaint": "This is outrageous! I paid for {g} and want my money at once.",
}
PLAIN = ["It is {d}: {g}. I changed my mind.", "I ordered {g} by mistake, please refund me.", "I expected more of {g} and would like to send it back."]
USED, DAMAGED = " I have tried it out.", " The box is torn."
EVIDENCE = {
    "quality_issue": ("Photos or a film are attached.", "No usable photos so far."), "logistics_issue": ("The tracking shows the loss, or the seller admits it.", "It is open who lost the parcel."),
    "strong_complaint": ("Something was sent in that does not match the words.", "Angry words, nothing that could be checked."),
}
#: Why a base outcome holds, by decision and reason code.
REASONS = {
    ("allow_refund", "logistics_issue"): "The parcel went wrong and it is clear by whom, so the money goes back.", ("request_more_evidence", "logistics_issue"): "The parcel may have gone wrong, but nothing shows it yet.",
    ("request_more_evidence", "quality_issue_no_evidence"): "A fault is claimed without anything that shows it.", ("allow_refund", "quality_issue_with_evidence"): "The fault is shown and the goods cannot be sold again, so they stay.",
    ("allow_return_refund", "quality_issue_with_evidence"): "The fault is shown and the goods can come back.", ("deny", "virtual_goods_denied"): "Digital goods are not taken back without a fault.", ("deny", "fresh_goods_no_reason_denied"): "Fresh goods are not taken back without a fault.",
    ("deny", "customized_goods_no_reason_denied"): "Goods made to order are not taken back without a fault.", ("allow_exchange", "within_7_days_unused"): "Unused within a week: an exchange is possible.",
    ("allow_return_refund", "within_7_days_unused"): "Unused within a week: the goods can come back.", ("deny", "used_or_not_resellable"): "Within a week, but used or not to be sold again.", ("deny", "over_7_days_no_quality_issue"): "More than a week has passed and no fault is shown.",
}


def _filled(template: str, goods: Column, since: Column) -> Column:
    parts = []
    for k, piece in enumerate(template.split("{g}")):
        parts += [goods] if k else []
        for j, text in enumerate(piece.split("{d}")):
            parts += ([since] if j else []) + [F.lit(text)]
    return F.concat(*parts)


def request(draw: Column) -> Column:
    """The customer's words; draw in [0, 1) picks one of the texts without a reason."""
    goods = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in GOODS.items() for x in pair)), F.col("product_type")), F.lit("goods"))
    since = F.when(F.col("days_since_delivery").isin(0, 1), "brand new").otherwise(F.concat(F.coalesce(F.col("days_since_delivery").cast("string"), F.lit("some")), F.lit(" days old")))
    plain = F.element_at(F.array(*(_filled(t, goods, since) for t in PLAIN)), (F.floor(draw * len(PLAIN)) + 1).cast("int"))
    chain = None
    for claim, template in ASKS.items():
        text = _filled(template, goods, since)
        chain = F.when(F.col("user_claim") == claim, text) if chain is None else chain.when(F.col("user_claim") == claim, text)
    used = F.when(F.col("is_used") & (F.col("user_claim") != "claims_unused_but_used"), USED).otherwise("")
    return F.concat(chain.otherwise(plain), used, F.when(~F.coalesce("is_resellable", F.lit(True)), DAMAGED).otherwise(""))


def evidence() -> Column:
    """What is said of the evidence where a claim calls for some; null elsewhere. A parcel's loss is also shown by the seller's fault."""
    chain = None
    for claim, (there, none) in EVIDENCE.items():
        shown = F.col("has_evidence") | F.col("seller_fault") if claim == "logistics_issue" else F.col("has_evidence")
        text = F.when(F.coalesce(shown, F.lit(False)), there).otherwise(none)
        chain = F.when(F.col("user_claim") == claim, text) if chain is None else chain.when(F.col("user_claim") == claim, text)
    return chain


def difficult(rows: DataFrame, position: str = "position") -> DataFrame:
    """rows with those at the positions of the difficult cases (1 to 17) replaced by these; the others unchanged. Every
    case takes the place of one row, so its further columns are null."""
    cases = []
    for k, change in enumerate(DIFFICULT, 1):
        case = {**COMMON, **change}
        cases.append((k, *case.values(), *(case["product_type"] == kind for kind in ("fresh", "customized", "virtual"))))
    kinds = dict(rows.dtypes)
    names = [position, *COMMON, "is_fresh", "is_customized", "is_virtual"]
    listed = rows.sparkSession.createDataFrame(cases, ", ".join(f"{c} {kinds[c]}" for c in names))
    held = listed.join(rows.where(F.col(position) <= len(DIFFICULT)).select(position), position, "left_semi")
    return rows.where(F.col(position) > len(DIFFICULT)).unionByName(held, allowMissingColumns=True)


def drawn(seed: str, position: Column) -> Column:
    return layout.unit(seed, "words", position)


def explained(decided: DataFrame, base: Column, missing: str) -> DataFrame:
    """decided (of rules.decide_refund) with explanation: what is missing, else why the base outcome holds and, where there
    are risks, which ones send it to a person. base is the struct (decision, code) that holds without risks."""
    reasons = F.create_map(*(F.lit(x) for (d, c), text in REASONS.items() for x in (f"{d}|{c}", text)))
    why = F.try_element_at(reasons, F.concat_ws("|", base["decision"], base["code"]))
    lacking = F.array_join(F.array_compact(F.array(F.when(F.col("days_since_delivery").isNull(), "days_since_delivery"), F.when(~F.coalesce(F.col("order_status").isin("delivered", "not_delivered", "closed"), F.lit(False)), "order_status"))), ", ")
    risks = F.array_join(F.expr("slice(reason_codes, 2, greatest(size(reason_codes) - 2, 0))"), ", ")
    text = F.when(F.expr(missing), F.concat(F.lit("The order does not tell "), lacking, F.lit("."))).when(F.col("need_human"), F.concat(why, F.lit(" A person decides because of: "), risks, F.lit("."))).otherwise(why)
    return decided.withColumn("explanation", text)
