from saldo.functions import scalars
from saldo.functions.transforms import TRANSFORMS, transform_for

__all__ = ["scalars", "TRANSFORMS", "transform_for"]
