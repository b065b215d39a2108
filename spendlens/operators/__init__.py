"""DataFrame -> DataFrame operators.

``clean``         C1-C11: header mapping, parsing, imputation, de-duplication, types
``quantiles``     exact medians by distributed histogram narrowing
``filters``       F1-F12: filters, parameter rules, period resolution
``aggregates``    A1-A9, A11: chart and dashboard aggregations
``windows``       W1-W6: share, growth, ranks, label thinning
``reshape``       P1-P14: units, relabelling, age order, pivot, coordinates, months
``requests_log``  R1-R4, J2, J3, S6: request-log analytics
"""
