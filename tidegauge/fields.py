"""Public payload columns and the raw columns that they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public name and raw name of each payload column, in order.
INCOME = {
    "basic_earnings_per_share": "basic_eps", "diluted_earnings_per_share": "diluted_eps", "total_revenue": "total_revenue",
    "operating_revenue": "revenue", "interest_income": "int_income", "earned_premiums": "prem_earned", "fee_and_commission_income": "comm_income",
    "net_fee_and_commission_income": "n_commis_income", "net_other_operating_income": "n_oth_income", "other_operating_income": "oth_b_income",
    "fair_value_change_gain": "fv_value_chg_gain", "investment_income": "invest_income", "associates_and_joint_ventures_income": "ass_invest_income",
    "foreign_exchange_gain": "forex_gain", "total_operating_costs": "total_cogs", "operating_costs": "oper_cost", "interest_expenses": "int_exp",
    "fee_and_commission_expenses": "comm_exp", "taxes_and_surcharges": "biz_tax_surchg", "selling_expenses": "sell_exp",
    "administrative_expenses": "admin_exp", "financial_expenses": "fin_exp", "asset_impairment_losses": "assets_impair_loss",
    "research_and_development_expenses": "rd_exp", "operating_profit": "operate_profit", "non_operating_income": "non_oper_income",
    "non_operating_expenses": "non_oper_exp", "total_profit": "total_profit", "income_tax_expenses": "income_tax", "net_income": "n_income",
    "net_income_attributable_to_parent": "n_income_attr_p", "minority_interest_income": "minority_gain",
    "other_comprehensive_income": "oth_compr_income", "total_comprehensive_income": "t_compr_income",
    "comprehensive_income_attributable_to_parent": "compr_inc_attr_p", "comprehensive_income_attributable_to_minority": "compr_inc_attr_m_s",
    "earnings_before_interest_and_tax": "ebit", "earnings_before_interest_tax_depreciation_and_amortization": "ebitda",
    "continuing_operations_net_income": "continued_net_profit",
}
BALANCE_SHEET = {
    "share_capital": "total_share", "capital_reserve": "cap_rese", "surplus_reserve": "surplus_rese", "special_reserve": "special_rese",
    "retained_earnings": "undistr_porfit", "treasury_stock": "treasury_share", "monetary_funds": "money_cap", "trading_financial_assets": "trad_asset",
    "derivative_financial_assets": "deriv_assets", "notes_receivable": "notes_receiv", "accounts_receivable": "accounts_receiv",
    "prepayments": "prepayment", "interest_receivable": "int_receiv", "dividends_receivable": "div_receiv", "other_receivables": "oth_rcv_total",
    "inventories": "inventories", "other_current_assets": "oth_cur_assets", "total_current_assets": "total_cur_assets",
    "available_for_sale_financial_assets": "fa_avail_for_sale", "held_to_maturity_investments": "htm_invest",
    "long_term_equity_investments": "lt_eqt_invest", "investment_property": "invest_real_estate", "fixed_assets": "fix_assets_total",
    "construction_in_progress": "cip_total", "construction_materials": "const_materials", "intangible_assets": "intan_assets", "goodwill": "goodwill",
    "long_term_deferred_expenses": "lt_amor_exp", "deferred_tax_assets": "defer_tax_assets", "other_non_current_assets": "oth_nca",
    "total_non_current_assets": "total_nca", "total_assets": "total_assets", "short_term_borrowings": "st_borr",
    "trading_financial_liabilities": "trading_fl", "derivative_financial_liabilities": "deriv_liab", "notes_payable": "notes_payable",
    "accounts_payable": "acct_payable", "contract_liabilities": "contract_liab", "employee_benefits_payable": "payroll_payable",
    "taxes_payable": "taxes_payable", "interest_payable": "int_payable", "dividends_payable": "div_payable", "other_payables": "oth_pay_total",
    "current_portion_of_non_current_liabilities": "non_cur_liab_due_1y", "other_current_liabilities": "oth_cur_liab",
    "total_current_liabilities": "total_cur_liab", "long_term_borrowings": "lt_borr", "bonds_payable": "bond_payable",
    "long_term_payables": "lt_payable", "specific_payables": "specific_payables", "deferred_tax_liabilities": "defer_tax_liab",
    "other_non_current_liabilities": "oth_ncl", "total_non_current_liabilities": "total_ncl", "total_liabilities": "total_liab",
    "equity_attributable_to_parent": "total_hldr_eqy_exc_min_int", "minority_interests": "minority_int", "total_equity": "total_hldr_eqy_inc_min_int",
    "total_liabilities_and_equity": "total_liab_hldr_eqy",
}
CASH_FLOW = {
    "cash_received_from_sales_and_services": "c_fr_sale_sg", "tax_refunds_received": "recp_tax_rends",
    "other_operating_cash_receipts": "c_fr_oth_operate_a", "total_operating_cash_inflows": "c_inf_fr_operate_a",
    "cash_paid_for_goods_and_services": "c_paid_goods_s", "cash_paid_to_employees": "c_paid_to_for_empl", "taxes_paid": "c_paid_for_taxes",
    "other_operating_cash_payments": "oth_cash_pay_oper_act", "total_operating_cash_outflows": "st_cash_out_act",
    "net_operating_cash_flow": "n_cashflow_act", "cash_received_from_investment_disposals": "c_disp_withdrwl_invest",
    "cash_received_from_investment_returns": "c_recp_return_invest", "cash_received_from_asset_disposals": "n_recp_disp_fiolta",
    "cash_received_from_subsidiary_disposals": "n_recp_disp_sobu", "other_investing_cash_receipts": "oth_recp_ral_inv_act",
    "total_investing_cash_inflows": "stot_inflows_inv_act", "cash_paid_for_asset_acquisitions": "c_pay_acq_const_fiolta",
    "cash_paid_for_investments": "c_paid_invest", "cash_paid_for_subsidiary_acquisitions": "n_disp_subs_oth_biz",
    "other_investing_cash_payments": "oth_pay_ral_inv_act", "total_investing_cash_outflows": "stot_out_inv_act",
    "net_investing_cash_flow": "n_cashflow_inv_act", "cash_received_from_capital_contributions": "c_recp_cap_contrib",
    "cash_received_from_borrowings": "c_recp_borrow", "cash_received_from_bond_issuance": "proc_issue_bonds",
    "other_financing_cash_receipts": "oth_cash_recp_ral_fnc_act", "total_financing_cash_inflows": "stot_cash_in_fnc_act",
    "cash_paid_for_debt_repayments": "c_prepay_amt_borr", "cash_paid_for_dividends_and_interest": "c_pay_dist_dpcp_int_exp",
    "other_financing_cash_payments": "oth_cashpay_ral_fnc_act", "total_financing_cash_outflows": "stot_cashout_fnc_act",
    "net_financing_cash_flow": "n_cash_flows_fnc_act", "effect_of_exchange_rate_changes": "eff_fx_flu_cash",
    "net_change_in_cash_and_cash_equivalents": "n_incr_cash_cash_equ", "cash_and_cash_equivalents_at_beginning": "c_cash_equ_beg_period",
    "cash_and_cash_equivalents_at_end": "c_cash_equ_end_period", "net_income": "net_profit", "asset_impairment_provisions": "prov_depr_assets",
    "depreciation_of_fixed_assets": "depr_fa_coga_dpba", "amortization_of_intangible_assets": "amort_intang_assets",
    "amortization_of_long_term_deferred_expenses": "lt_amort_deferred_exp", "financial_expenses": "finan_exp", "investment_losses": "invest_loss",
    "free_cash_flow": "free_cashflow",
}
INDICATORS = {
    "basic_earnings_per_share": "eps", "diluted_earnings_per_share": "dt_eps", "net_assets_per_share": "bps", "operating_cash_flow_per_share": "ocfps",
    "capital_reserve_per_share": "capital_rese_ps", "surplus_reserve_per_share": "surplus_rese_ps", "retained_earnings_per_share": "undist_profit_ps",
    "gross_profit": "gross_margin", "gross_margin": "grossprofit_margin", "net_profit_margin": "netprofit_margin", "return_on_equity": "roe",
    "weighted_return_on_equity": "roe_waa", "return_on_assets": "roa", "return_on_invested_capital": "roic", "current_ratio": "current_ratio",
    "quick_ratio": "quick_ratio", "cash_ratio": "cash_ratio", "debt_to_assets": "debt_to_assets", "asset_turnover": "assets_turn",
    "inventory_turnover": "inv_turn", "accounts_receivable_turnover": "ar_turn", "revenue_year_over_year": "or_yoy",
    "net_income_year_over_year": "netprofit_yoy", "operating_cash_flow_year_over_year": "ocf_yoy",
}
FORECAST = {
    "forecast_type": "type", "net_income_change_lower_bound": "p_change_min", "net_income_change_upper_bound": "p_change_max",
    "net_income_lower_bound": "net_profit_min", "net_income_upper_bound": "net_profit_max", "prior_period_net_income": "last_parent_net",
    "first_announcement_date": "first_ann_date", "summary": "summary", "change_reason": "change_reason",
}
EXPRESS = {
    "operating_revenue": "revenue", "operating_profit": "operate_profit", "total_profit": "total_profit",
    "net_income_attributable_to_parent": "n_income", "total_assets": "total_assets", "equity_attributable_to_parent": "total_hldr_eqy_exc_min_int",
    "diluted_earnings_per_share": "diluted_eps", "diluted_return_on_equity": "diluted_roe", "prior_period_net_income": "yoy_net_profit",
    "net_assets_per_share": "bps", "revenue_year_over_year": "yoy_sales", "operating_profit_year_over_year": "yoy_op",
    "total_profit_year_over_year": "yoy_tp", "net_income_year_over_year": "yoy_dedu_np", "earnings_per_share_year_over_year": "yoy_eps",
    "return_on_equity_year_over_year": "yoy_roe", "total_assets_growth": "growth_assets", "equity_year_over_year": "yoy_equity",
    "net_assets_per_share_growth": "growth_bps", "summary": "perf_summary", "is_audited": "is_audit", "remark": "remark",
}
AUDIT = {
    "audit_opinion": "audit_result", "audit_fees": "audit_fees", "audit_firm": "audit_agency", "signing_accountants": "audit_sign",
}
# Raw columns that stand in for a public column's where that is null.
STAND_INS = {"other_receivables": "oth_receiv", "fixed_assets": "fix_assets", "construction_in_progress": "cip", "other_payables": "oth_payable"}
# Public columns that raw tables have in percent, and those that they have in ten thousands.
PERCENT = {
    "gross_margin", "net_profit_margin", "return_on_equity", "weighted_return_on_equity", "return_on_assets",
    "return_on_invested_capital", "debt_to_assets", "revenue_year_over_year", "net_income_year_over_year",
    "operating_cash_flow_year_over_year", "diluted_return_on_equity", "operating_profit_year_over_year", "total_profit_year_over_year",
    "earnings_per_share_year_over_year", "return_on_equity_year_over_year", "total_assets_growth", "equity_year_over_year",
    "net_assets_per_share_growth", "net_income_change_lower_bound", "net_income_change_upper_bound",
}
TEN_THOUSANDS = {"net_income_lower_bound", "net_income_upper_bound", "prior_period_net_income"}
# Codes of company types.
COMPANY_TYPES = {"1": "industrial", "2": "bank", "3": "insurance", "4": "securities"}

PAYLOADS = {
    "income": INCOME, "balance_sheet": BALANCE_SHEET, "cash_flow": CASH_FLOW, "indicators": INDICATORS,
    "forecast": FORECAST, "express": EXPRESS, "audit": AUDIT,
}


def payload(kind: str, names: list[str] | None = None) -> list[Column]:
    """The public columns of a kind of report, all of them or those named, in public units: ratios, and whole currency units.

    Units belong to a kind: express reports have their prior income whole, forecasts in ten thousands.
    """
    out = []
    for public, raw in PAYLOADS[kind].items():
        if names is not None and public not in names:
            continue
        column = F.coalesce(raw, STAND_INS[public]) if kind == "balance_sheet" and public in STAND_INS else F.col(raw)
        if kind in ("indicators", "express", "forecast") and public in PERCENT:
            column = column.cast("double") * 0.01
        elif kind == "forecast" and public in TEN_THOUSANDS:
            column = column.cast("double") * 10_000.0
        elif public == "is_audited":
            column = column.cast("boolean")
        out.append(column.alias(public))
    return out


def company_type(column: str) -> Column:
    """The public name of a company type's code; other codes are null."""
    found = F.lit(None).cast("string")
    for code, name in COMPANY_TYPES.items():
        found = F.when(F.col(column) == code, name).otherwise(found)
    return found
