"""Cross-checks of two sources of the same facts: daily bars, reproduced adjustment, financial reports, dividends.

A check is a DataFrame (check, code, day, field, left_value, right_value, verdict) of everything that was compared. Verdicts are
equal and differs, left_missing, right_missing, both_missing and no_factor for whole rows (field __row__), and invalid.
"""

from __future__ import annotations

import random
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import RequestError, UnavailableError
from tidegauge.functions.values import is_close, last_first
from tidegauge.operators.bars import latest
from tidegauge.scratch import cut

ROW = "__row__"
PRICES = ("open", "high", "low", "close")
# Downloaded tables of reports, the vendor's table of each, and the field of the one that is the other's; where
# there are several, the vendor has a fact under one or another.
REPORTS = {
    "Balance": ("balancesheet", {
        "cash_equivalents": "money_cap", "tradable_fin_assets": "trad_asset", "derivative_fin_assets": "deriv_assets", "bill_receivable": "notes_receiv",
        "account_receivable": "accounts_receiv", "advance_payment": "prepayment", "int_rcv": "int_receiv",
        "other_receivable": ("oth_receiv", "oth_rcv_total"), "inventories": "inventories", "other_current_assets": "oth_cur_assets",
        "total_current_assets": "total_cur_assets", "fin_assets_avail_for_sale": "fa_avail_for_sale", "held_to_mty_invest": "htm_invest",
        "long_term_eqy_invest": "lt_eqt_invest", "invest_real_estate": "invest_real_estate", "fix_assets": ("fix_assets", "fix_assets_total"),
        "constru_in_process": ("cip", "cip_total"), "construction_materials": "const_materials", "intang_assets": "intan_assets", "goodwill": "goodwill",
        "long_deferred_expense": "lt_amor_exp", "deferred_tax_assets": "defer_tax_assets", "total_non_current_assets": "total_nca",
        "tot_assets": "total_assets", "shortterm_loan": "st_borr", "tradable_fin_liab": "trading_fl", "empl_ben_payable": "payroll_payable",
        "taxes_surcharges_payable": "taxes_payable", "int_payable": "int_payable", "bonds_payable": "bond_payable", "deferred_tax_liab": "defer_tax_liab",
        "tot_liab": "total_liab", "cap_stk": "total_share", "cap_rsrv": "cap_rese", "surplus_rsrv": "surplus_rese", "undistributed_profit": "undistr_porfit",
        "dividend_payable": "div_payable", "other_payable": ("oth_payable", "oth_pay_total"), "non_current_liability_in_one_year": "non_cur_liab_due_1y",
        "other_current_liability": "oth_cur_liab", "longterm_account_payable": "lt_payable", "accounts_payable": "acct_payable",
        "advance_peceipts": "contract_liab", "total_current_liability": "total_cur_liab", "notes_payable": "notes_payable", "long_term_loans": "lt_borr",
        "grants_received": "specific_payables", "other_non_current_liabilities": "oth_ncl", "non_current_liabilities": "total_ncl",
        "specific_reserves": "special_rese", "minority_int": "minority_int", "tot_shrhldr_eqy_excl_min_int": "total_hldr_eqy_exc_min_int",
        "total_equity": "total_hldr_eqy_inc_min_int", "tot_liab_shrhldr_eqy": "total_liab_hldr_eqy",
    }),
    "Income": ("income", {
        "revenue_inc": "revenue", "revenue": "total_revenue", "earned_premium": "prem_earned", "total_expense": "oper_cost", "research_expenses": "rd_exp",
        "change_income_fair_value": "fv_value_chg_gain", "int_inc": "int_income", "handling_chrg_comm_inc": "comm_income",
        "less_handling_chrg_comm_exp": "comm_exp", "other_bus_cost": "other_bus_cost", "plus_net_gain_fx_trans": "forex_gain", "inc_tax": "income_tax",
        "net_profit_excl_min_int_inc": "n_income_attr_p", "less_int_exp": "int_exp", "other_bus_inc": "oth_b_income",
        "less_taxes_surcharges_ops": "biz_tax_surchg", "sale_expense": "sell_exp", "less_gerl_admin_exp": "admin_exp", "financial_expense": "fin_exp",
        "less_impair_loss_assets": "assets_impair_loss", "plus_net_invest_inc": "invest_income", "incl_inc_invest_assoc_jv_entp": "ass_invest_income",
        "oper_profit": "operate_profit", "plus_non_oper_rev": "non_oper_income", "less_non_oper_exp": "non_oper_exp", "tot_profit": "total_profit",
        "net_profit_incl_min_int_inc": "n_income", "minority_int_inc": "minority_gain", "s_fa_eps_basic": "basic_eps", "s_fa_eps_diluted": "diluted_eps",
        "total_income": "t_compr_income", "total_income_minority": "compr_inc_attr_m_s",
    }),
    "CashFlow": ("cashflow", {
        "net_profit": "net_profit", "cash_received_ori_ins_contract_pre": "prem_fr_orig_contr", "net_cash_received_rei_ope": "n_reinsur_prem",
        "net_increase_insured_funds": "n_incr_insured_dep", "cash_for_payment_original_insurance": "c_pay_claims_orig_inco",
        "cash_payment_policy_dividends": "pay_comm_insur_plcy", "cash_paid_for_investments": "c_paid_invest",
        "cash_paid_by_subsidiaries": "n_disp_subs_oth_biz", "other_cash_recp_ral_oper_act": "c_fr_oth_operate_a",
        "goods_sale_and_service_render_cash": "c_fr_sale_sg", "tax_levy_refund": "recp_tax_rends", "stot_cash_inflows_oper_act": "c_inf_fr_operate_a",
        "goods_and_services_cash_paid": "c_paid_goods_s", "net_incr_clients_loan_adv": "n_incr_clt_loan_adv", "net_incr_dep_cbob": "n_incr_dep_cbob",
        "handling_chrg_paid": "pay_handling_chrg", "cash_pay_beh_empl": "c_paid_to_for_empl", "pay_all_typ_tax": "c_paid_for_taxes",
        "other_cash_pay_ral_oper_act": "oth_cash_pay_oper_act", "stot_cash_outflows_oper_act": "st_cash_out_act",
        "net_cash_flows_oper_act": "n_cashflow_act", "cash_recp_disp_withdrwl_invest": "c_disp_withdrwl_invest",
        "cash_recp_return_invest": "c_recp_return_invest", "net_cash_recp_disp_fiolta": "n_recp_disp_fiolta",
        "other_cash_recp_ral_inv_act": "oth_recp_ral_inv_act", "stot_cash_inflows_inv_act": "stot_inflows_inv_act",
        "cash_pay_acq_const_fiolta": "c_pay_acq_const_fiolta", "other_cash_pay_ral_inv_act": "oth_pay_ral_inv_act",
        "stot_cash_outflows_inv_act": "stot_out_inv_act", "net_cash_flows_inv_act": "n_cashflow_inv_act", "cash_recp_cap_contrib": "c_recp_cap_contrib",
        "cash_recp_borrow": "c_recp_borrow", "proc_issue_bonds": "proc_issue_bonds", "other_cash_recp_ral_fnc_act": "oth_cash_recp_ral_fnc_act",
        "stot_cash_inflows_fnc_act": "stot_cash_in_fnc_act", "cash_prepay_amt_borr": "c_prepay_amt_borr",
        "cash_pay_dist_dpcp_int_exp": "c_pay_dist_dpcp_int_exp", "other_cash_pay_ral_fnc_act": "oth_cashpay_ral_fnc_act",
        "stot_cash_outflows_fnc_act": "stot_cashout_fnc_act", "net_cash_flows_fnc_act": "n_cash_flows_fnc_act", "eff_fx_flu_cash": "eff_fx_flu_cash",
        "net_incr_cash_cash_equ": "n_incr_cash_cash_equ", "cash_cash_equ_beg_period": "c_cash_equ_beg_period",
        "cash_cash_equ_end_period": "c_cash_equ_end_period",
    }),
    "Pershareindex": ("fina_indicator", {
        "s_fa_ocfps": "ocfps", "s_fa_bps": "bps", "s_fa_eps_basic": "eps", "s_fa_eps_diluted": "dt_eps", "s_fa_undistributedps": "undist_profit_ps",
        "s_fa_surpluscapitalps": "capital_rese_ps", "du_return_on_equity": "roe", "sales_gross_profit": "grossprofit_margin",
    }),
}
# Fixed value: fields that are rounded to a cent.
PER_SHARE = ("s_fa_eps_basic", "s_fa_eps_diluted")


@dataclass(frozen=True)
class Pair:
    """Two columns that should be equal within the larger of two tolerances."""

    field: str
    left: Column
    right: Column
    rtol: float = 1e-6
    atol: float = 1e-6


def _verdict(p: Pair) -> Column:
    """A struct of the pair, null if both are null."""
    left, right = p.left.cast("double"), p.right.cast("double")
    same = F.coalesce((left == right) & ~F.isnan(left) | is_close(left, right, p.rtol, p.atol), F.lit(False))
    made = F.struct(F.lit(p.field).alias("field"), left.alias("left_value"), right.alias("right_value"), F.when(same, "equal").otherwise("differs").alias("verdict"))
    return F.when(p.left.isNotNull() | p.right.isNotNull(), made)


def _row(verdict: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(F.lit(ROW).alias("field"), none.alias("left_value"), none.alias("right_value"), verdict.alias("verdict"))


def _missing(left: Column, right: Column) -> Column:
    return F.when(~left & ~right, "both_missing").when(~left, "left_missing").when(~right, "right_missing")


def _compared(check: str, both: DataFrame, missing: Column, pairs: list[Pair]) -> DataFrame:
    """One row for each pair of each (code, day), or one for a row that `missing` gives a verdict for."""
    each = F.when(missing.isNotNull(), F.array(_row(missing))).otherwise(F.filter(F.array(*[_verdict(p) for p in pairs]), lambda x: x.isNotNull()))
    return both.select(F.lit(check).alias("check"), "code", "day", F.explode(each).alias("x")).select("check", "code", "day", "x.*")


def _within(df: DataFrame, day: str, start: str, end: str, code: str, codes: list[str] | None) -> DataFrame:
    df = df.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumnsRenamed({code: "code", day: "day"})
    return df if codes is None else df.where(F.col("code").isin(codes))


def _named(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select("code", "day", *[F.col(c).alias(f"{side}_{c}") for c in columns], F.lit(True).alias(f"{side}_"))


def _has(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_"), F.lit(False))


def sample_codes(daily: DataFrame, start: str, end: str, size: int, seed: int = 0) -> list[str]:
    """`size` codes that have daily rows in [start, end], drawn by the seed from their sorted list (one entry a code), sorted."""
    if size < 1:
        raise RequestError("a sample has one code or more")
    codes = [r[0] for r in daily.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("ts_code").distinct().orderBy("ts_code").collect()]
    if not codes:
        raise UnavailableError("no daily rows to draw from")
    return sorted(random.Random(seed).sample(codes, min(size, len(codes))))


def daily(vendor: DataFrame, factors: DataFrame, downloaded: DataFrame, start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    """Raw bars of both sources (volumes in lots, to half a lot; amounts in thousands), and, if front_ratio bars were
    downloaded, vendor prices times the day's factor over the latest one up to `end`."""
    left = _named(_within(vendor, "trade_date", start, end, "ts_code", codes), "t", [*PRICES, "vol", "amount"])
    right = _within(downloaded, "trade_date", start, end, "code", codes)
    raw, front = (_named(right.where(F.col("adjustment") == a), s, [*PRICES, *more]) for a, s, more in (("none", "n", ("volume", "amount")), ("front_ratio", "f", ())))
    keys = ["code", "day"]
    both = left.join(right.select(*keys).distinct().withColumn("_k", F.lit(True)), keys, "full_outer").join(raw, keys, "left")
    pairs = [*(Pair(c, F.col(f"t_{c}"), F.col(f"n_{c}")) for c in PRICES), Pair("volume", F.col("t_vol"), F.col("n_volume"), atol=0.500001), Pair("amount", F.col("t_amount"), F.col("n_amount") / 1000)]
    out = _compared("daily_none", both, _missing(_has("t"), _has("n")), pairs)
    if right.where("adjustment = 'front_ratio'").isEmpty():
        return out
    own = factors.where(F.col("trade_date") <= F.lit(end).cast("date")).select(F.col("ts_code").alias("code"), F.col("trade_date").alias("day"), F.col("adj_factor").alias("factor"))
    last = latest(own.where("factor is not null"), ["code"], last_first("day")).select("code", F.col("factor").alias("last"))
    fronts = left.join(right.select(*keys).distinct(), keys, "full_outer").join(front, keys, "left").join(own, keys, "left").join(last, "code", "left")
    lost = F.coalesce(_missing(_has("t"), _has("f")), F.when(F.col("factor").isNull() | F.col("last").isNull(), "no_factor"))
    expected = lambda c: F.try_divide(F.col(f"t_{c}") * F.col("factor"), F.col("last"))
    return out.unionByName(_compared("daily_front", fronts, lost, [Pair(c, expected(c), F.col(f"f_{c}"), 1e-5, 0.005001) for c in PRICES]))


def front_ratio(downloaded: DataFrame, native: DataFrame, events: DataFrame, start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    """Raw bars over the product of the ratios of all later events, against bars that the source adjusted itself (native:
    code, trade_date and the columns of a bar). A later event without a positive ratio makes a day invalid."""
    columns = [*PRICES, "preClose", "volume", "amount"]
    raw = _named(_within(downloaded.where("adjustment = 'none'"), "trade_date", start, end, "code", codes), "r", columns)
    own = _named(native.withColumnRenamed("trade_date", "day"), "n", columns)
    later = raw.select("code", "day").join(events.select("code", "ex_date", "dr"), "code").where("ex_date > day")
    ratio = later.groupBy("code", "day").agg(F.product("dr").alias("ratio"), F.bool_or(F.col("dr").isNull() | (F.col("dr") <= 0)).alias("bad"))
    both = raw.join(own, ["code", "day"], "left").join(ratio, ["code", "day"], "left")
    divisor = F.coalesce("ratio", F.lit(1.0))
    state = F.when(~_has("n"), "right_missing").when(F.col("bad"), "invalid")
    pairs = [*(Pair(c, F.col(f"r_{c}") / divisor, F.col(f"n_{c}"), 1e-12, 1e-12) for c in columns[:5]), *(Pair(c, F.col(f"r_{c}"), F.col(f"n_{c}")) for c in columns[5:])]
    return _compared("front_ratio", both, state, pairs)


def financial(vendor: Mapping[str, DataFrame], downloaded: DataFrame, start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    """Reports of both sources, the last version of each period. downloaded: code, dataset, report_date, disclosure_date,
    data_json. A field that a downloaded report lacks is not compared; null is zero; of several vendor columns the one
    nearest to the downloaded value counts, and the first where that has none."""
    right = _within(downloaded, "report_date", start, end, "code", codes).withColumn("dataset", F.lower("dataset"))
    right = latest(right, ["code", "dataset", "day"], last_first("disclosure_date")).withColumn("m", F.from_json("data_json", "map<string,string>"))
    flag, lefts, pairs = F.col("update_flag").try_cast("int").desc_nulls_last(), [], []
    for name, (table, fields) in REPORTS.items():
        rows = _within(vendor[table], "end_date", start, end, "ts_code", codes)
        if table == "fina_indicator":
            rows = latest(rows, ["code", "day"], [*last_first("ann_date"), flag])
        else:
            rows = latest(rows.where("report_type = '1'"), ["code", "day"], [*last_first("f_ann_date"), flag])
        choices = {theirs: [ours] if isinstance(ours, str) else list(ours) for theirs, ours in fields.items()}
        columns = list(dict.fromkeys(c for own in choices.values() for c in own))
        facts = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))
        lefts.append(rows.select("code", "day", F.lit(name.lower()).alias("dataset"), facts.alias("facts")))
        pairs += [(name.lower(), f"financial_{name}", theirs, own, 0.005001 if theirs in PER_SHARE else 1e-4) for theirs, own in choices.items()]
    left = lefts[0]
    for more in lefts[1:]:
        left = left.unionByName(more)
    spark = left.sparkSession
    names = F.create_map(*[x for n in REPORTS for x in (F.lit(n.lower()), F.lit(f"financial_{n}"))])
    known = right.where(F.col("dataset").isin([n.lower() for n in REPORTS])).select("code", "day", "dataset", "m")
    return _reports(left.join(known, ["code", "day", "dataset"], "full_outer"), spark.createDataFrame(pairs, "dataset string, check string, theirs string, ours array<string>, atol double"), names)


def _reports(both: DataFrame, pairs: DataFrame, names: Column) -> DataFrame:
    """Reports of both sides (facts and m, maps) compared. Fields are rows, joined with the table of pairs, so the plan does not
    grow with their number."""
    state = _row(F.when(F.col("facts").isNull(), "left_missing").otherwise("right_missing"))
    lost = both.where("facts is null or m is null").select(F.element_at(names, F.col("dataset")).alias("check"), "code", "day", state.alias("x"))
    each = both.where("facts is not null and m is not null").select("code", "day", "dataset", "facts", F.explode("m").alias("theirs", "text")).join(F.broadcast(pairs), ["dataset", "theirs"])
    own = each.withColumns({"r": F.col("text").try_cast("double"), "own": F.transform("ours", lambda c: F.element_at("facts", c))})
    known = F.filter("own", lambda v: v.isNotNull())
    near = F.array_min(F.transform(known, lambda v, i: F.struct(F.abs(v - F.col("r")).alias("gap"), i.alias("i"), v.alias("v"))))["v"]
    chosen = own.withColumn("l", F.when(F.col("r").isNotNull() & (F.size(known) > 0), near).otherwise(F.get("own", F.lit(0))))
    zero = chosen.withColumns({"l": F.when(F.col("l").isNull() & (F.col("r") == 0), 0.0).otherwise(F.col("l")), "r": F.when(F.col("r").isNull() & (F.col("l") == 0), 0.0).otherwise(F.col("r"))})
    close = F.abs(F.col("l") - F.col("r")) <= F.greatest(1e-6 * F.greatest(F.abs("l"), F.abs("r")), F.col("atol"))
    same = F.coalesce((F.col("l") == F.col("r")) | close, F.lit(False))
    found = zero.where("l is not null or r is not null").select("check", "code", "day", F.struct(F.get("ours", F.lit(0)).alias("field"), F.col("l").alias("left_value"), F.col("r").alias("right_value"), F.when(same, "equal").otherwise("differs").alias("verdict")).alias("x"))
    return found.unionByName(lost).select("check", "code", "day", "x.*")


def dividends(vendor: DataFrame, events: DataFrame, start: str, end: str, codes: list[str] | None = None, done: str = "实施") -> DataFrame:
    """Dividends that were carried out, the last version of each plan, summed by day, against downloaded events."""
    plans = vendor.where(F.col("div_proc") == done)
    plans = plans if codes is None else plans.where(F.col("ts_code").isin(codes))
    plans = _within(latest(plans, ["ts_code", "end_date", "ann_date"], last_first("imp_ann_date")), "ex_date", start, end, "ts_code", codes)
    names = ["cash_div_tax", "stk_bo_rate", "stk_co_rate", "stk_div"]
    left = _named(plans.groupBy("code", "day").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in names]), "t", names)
    right = _named(_within(events, "ex_date", start, end, "code", codes), "d", ["interest", "stockBonus", "stockGift"])
    both = left.join(right, ["code", "day"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pairs = [Pair(t, zero(f"t_{t}"), zero(f"d_{d}")) for t, d in (("cash_div_tax", "interest"), ("stk_bo_rate", "stockBonus"), ("stk_co_rate", "stockGift"))]
    pairs.append(Pair("stk_div", zero("t_stk_div"), zero("d_stockBonus") + zero("d_stockGift")))
    return _compared("dividend", both, _missing(_has("t"), _has("d")), pairs)


@dataclass(frozen=True)
class Crosscheck:
    """Codes and the written table of all that was compared."""

    codes: tuple[str, ...]
    compared: DataFrame

    @cached_property
    def counts(self) -> dict[str, dict[str, int]]:
        """Of each check, how many pairs were compared and how many rows or pairs differ."""
        rows = self.compared.groupBy("check").agg(F.count_if(F.col("field") != ROW).alias("compared"), F.count_if(F.col("verdict") != "equal").alias("differences")).collect()
        return {r["check"]: {"compared": r["compared"], "differences": r["differences"]} for r in rows}

    @property
    def differences(self) -> DataFrame:
        return self.compared.where("verdict <> 'equal'")

    @property
    def passed(self) -> bool:
        return all(c["differences"] == 0 for c in self.counts.values())


def crosscheck(frames: Mapping[str, DataFrame], start: str, end: str, size: int = 20, seed: int = 0) -> Crosscheck:
    """All checks that frames have tables for, of a sample of codes. Tables: daily, adj_factor, income, balancesheet, cashflow,
    fina_indicator, dividend of the vendor; downloaded_daily, native_front, dividend_factors, financial of the download."""
    codes = sample_codes(frames["daily"], start, end, size, seed)
    made = []
    if {"daily", "adj_factor", "downloaded_daily"} <= set(frames):
        made.append(daily(frames["daily"], frames["adj_factor"], frames["downloaded_daily"], start, end, codes))
    if {"downloaded_daily", "native_front", "dividend_factors"} <= set(frames):
        made.append(front_ratio(frames["downloaded_daily"], frames["native_front"], frames["dividend_factors"], start, end, codes))
    if {"financial", *(t for t, _ in REPORTS.values())} <= set(frames):
        made.append(financial(frames, frames["financial"], start, end, codes))
    if {"dividend", "dividend_factors"} <= set(frames):
        made.append(dividends(frames["dividend"], frames["dividend_factors"], start, end, codes))
    if not made:
        raise UnavailableError("no two sources of one fact")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return Crosscheck(tuple(codes), cut(out, "crosscheck"))
