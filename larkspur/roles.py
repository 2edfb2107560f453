"""Column roles: which columns are numeric features, categories and target.

Every operator takes a table plus a ``ColumnRoles``; columns named in the
roles but absent from the table are skipped, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)

# The housing configuration (feature lists and target name).
HOUSING_NUMERIC = (
    "LotArea", "YearBuilt", "YearRemodAdd", "TotalBsmtSF", "GrLivArea",
    "FullBath", "HalfBath", "BedroomAbvGr", "TotRmsAbvGrd", "GarageArea",
    "PoolArea", "OverallQual", "OverallCond",
)
HOUSING_CATEGORICAL = (
    "MSZoning", "Street", "LotShape", "LandContour", "Utilities",
    "Neighborhood", "BldgType", "HouseStyle", "RoofStyle", "ExterQual",
    "HeatingQC", "KitchenQual", "GarageType", "SaleCondition",
)
HOUSING_TARGET = "SalePrice"
# Ordinal quality columns and the size columns screened for outliers.
ORDINAL_COLUMNS = ("ExterQual", "KitchenQual", "HeatingQC")
OUTLIER_COLUMNS = ("LotArea", "GrLivArea", "TotalBsmtSF", "GarageArea")


@dataclass(frozen=True)
class ColumnRoles:
    numeric: tuple = HOUSING_NUMERIC
    categorical: tuple = HOUSING_CATEGORICAL
    target: str = HOUSING_TARGET
    key: str = "id"
    ordinal: tuple = ORDINAL_COLUMNS
    outlier: tuple = OUTLIER_COLUMNS
    extra: dict = field(default_factory=dict)

    def present(self, df: DataFrame) -> "ColumnRoles":
        """Roles restricted to the columns that exist in ``df``."""
        cols = set(df.columns)
        return replace(
            self,
            numeric=tuple(c for c in self.numeric if c in cols),
            categorical=tuple(c for c in self.categorical if c in cols),
            ordinal=tuple(c for c in self.ordinal if c in cols),
            outlier=tuple(c for c in self.outlier if c in cols),
        )

    @property
    def nominal(self) -> tuple:
        """Categorical columns that are not ordinal (one-hot candidates)."""
        return tuple(c for c in self.categorical if c not in self.ordinal)


HOUSING = ColumnRoles()


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Type-class selection: numeric (bool excluded, as pandas number)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def split_features_target(df: DataFrame, target: str = HOUSING_TARGET, key: str = "id"):
    """Feature table and target table. The key column stays in both so
    they can be re-joined by key (never by position)."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to predict among {', '.join(df.columns)}")
    return df.drop(target), df.select(*[c for c in df.columns if c == key], target)
