"""A seeded demo table with planted defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _draw(salt: int, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the row and the seed only."""
    return F.pmod(F.xxhash64("id", F.lit(seed * 1000 + salt)), F.lit(1_000_000)) / 1_000_000


def _choice(u: Column, options: list[tuple[str, float]]) -> Column:
    out, total = None, 0.0
    for value, share in options[:-1]:
        total += share
        out = F.when(u < total, value) if out is None else out.when(u < total, value)
    return out.otherwise(options[-1][0])


def demo_dataset(spark: SparkSession, n: int = 600, seed: int = 7) -> DataFrame:
    """Employees with missing cells, label variants, numbers as text, a skewed column and
    ten repeated rows; the target depends on satisfaction, contract, tenure and hours."""
    u = lambda salt: _draw(salt, seed)
    bell = lambda salt: sum((u(salt * 10 + i) for i in range(4)), F.lit(0.0)) - 2.0
    tenure = F.round(F.least(F.lit(30.0), -4 * F.log(1 - u(5))), 1)
    satisfaction = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.62 + 0.35 * bell(6))), 2)
    contract = _choice(u(7), [("Permanent", 0.6), ("Contract", 0.25), ("Intern", 0.15)])
    hours = F.round(F.least(F.lit(310.0), F.greatest(F.lit(90.0), 175 + 55 * bell(8))), 0)
    base = spark.range(n).select(
        "id", F.concat(F.lit("E"), (1000 + F.col("id")).cast("string")).alias("EmployeeID"),
        F.when(u(1) >= 0.06, F.floor(20 + 45 * u(2)).cast("double")).alias("Age"),
        F.when(u(3) >= 0.03, _choice(u(4), [
            ("Sales", 0.28), ("sales", 0.07), ("Engineering", 0.3), ("engineering ", 0.05), ("Support", 0.22), ("SUPPORT", 0.08),
        ])).alias("Department"),
        _choice(u(9), [("Male", 0.35), ("male", 0.08), ("M", 0.07), ("Female", 0.36), ("female", 0.08), ("F", 0.06)]).alias("Gender"),
        contract.alias("ContractType"), tenure.alias("TenureYears"), hours.alias("MonthlyHours"), satisfaction.alias("_sat"),
        F.when(u(11) >= 0.09, satisfaction).alias("Satisfaction"),
        (F.floor(2500 + 5000 * u(12)) * F.when(F.col("id") % 120 == 0, 5).otherwise(1)).alias("_pay"),
    )
    risk = 1.6 - 3.2 * F.col("_sat") + F.when(F.col("ContractType") == "Permanent", -0.5).otherwise(0.4) - 0.05 * F.col("TenureYears") + (F.col("MonthlyHours") - 175) / 90
    rows = base.withColumn("MonthlySalary", F.format_number("_pay", 0)).withColumn(
        "Attrition", F.when(1 / (1 + F.exp(-risk)) > u(13), "Yes").otherwise("No")
    )
    repeated = rows.filter(F.col("id") < 10).withColumn("id", F.col("id") + n)
    names = ["EmployeeID", "Age", "Department", "Gender", "ContractType", "TenureYears", "MonthlyHours", "Satisfaction", "MonthlySalary", "Attrition"]
    return rows.unionByName(repeated).select(F.col("id").alias("_row_id"), *names)
