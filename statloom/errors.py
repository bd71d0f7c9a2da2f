"""Exceptions with the numeric codes of the statistics library's error conditions."""

from __future__ import annotations


class StatisticsError(ValueError):
    """Base of all errors; ``code`` tells callers which condition arose."""

    code = 0


class ArraySizeError(StatisticsError):
    code = 10000


class MatrixSizeError(StatisticsError):
    code = 10001


class InvalidInputError(StatisticsError):
    code = 10002


class OutOfMemoryError(StatisticsError):
    code = 10003


class UnderdefinedProblemError(StatisticsError):
    code = 10004


class ToleranceTooSmallError(StatisticsError):
    code = 10005


class TooFewIterationsError(StatisticsError):
    code = 10006


class InvalidArgumentError(StatisticsError):
    code = 10007


class ZeroVarianceError(StatisticsError):
    code = 10008


class NullPointerError(StatisticsError):
    code = 10009


class PolynomialOrderError(StatisticsError):
    code = 10010


class NonMonotonicError(StatisticsError):
    code = 10011


class UninitializedObjectError(StatisticsError):
    code = 10012
