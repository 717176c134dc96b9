"""Shared names, class codes and table schemas.

Tables used across the package (``slide_id`` may be any atomic type):

* cells      (slide_id, cell_ord long, cell_id string, cx double, cy double,
              cell_type int, contour array<array<double>>)
* mask       (slide_id, row int, col int, value int)          one row per pixel
* runs       (slide_id, row int, c0 int, c1 int)              foreground runs, inclusive
* frame      (slide_id, height int, width int)                image size
* features   (slide_id, section, grp, feature, value double)
* fm         (slide_id, feature, value double)                long feature matrix
* tile_pixels(tile_id, row, col, true_inst, pred_inst, true_class, pred_class)
"""

from pyspark.sql import types as T

# Class code -> class name, codes start at 1.
CLASS_NAMES = ["Granulocyte", "Lymphocyte", "Plasma", "Stroma", "Tumor", "Epithelial"]
BACKGROUND = "Background"

# Class code -> spelling used inside feature names.
FEATURE_NAMES = {
    1: "Granulocytes",
    2: "Lymphocytes",
    3: "PlasmaCells",
    4: "StromaCells",
    5: "TumorCells",
    6: "EpithelialCells",
}

TUMOUR_CLASSES = [1, 2, 3, 4, 5]
BAND_CLASSES = [1, 2, 3, 4, 6]
DISTANCE_CLASSES = [1, 2, 3, 5]

DOWN_FACTOR = 32
MARGIN = 4338

INSIDE = 255
OUTSIDE = 0

POINT = T.ArrayType(T.DoubleType())
NUCLEUS = T.StructType(
    [
        T.StructField("centroid", POINT),
        T.StructField("contour", T.ArrayType(POINT)),
        T.StructField("type", T.IntegerType()),
    ]
)
