"""Booking reports: segmentation (RP14) and the cancellation leaderboard (RP15).

Pipeline (as in the source analysis): date parts dropped, count-like columns
treated as categories and one-hot encoded, everything standardised (population
std), PCA with 4 components (explained variance; the first two are the 2-D
projection), a k sweep for the elbow, 4 hierarchical segments, per-segment
profiles; then 4 classifiers on the *unscaled* encoded features plus the
segment id (D21), fitted concurrently and scored on a 30 % hash hold-out.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators import classify, distributions, features, scan, segments
from bizlens.operators.clean import map_values
from bizlens.session import materialise, reliable

TARGET = "booking_status"
KEY = "Booking_ID"
PRICE = "avg_price_per_room"


@dataclass(frozen=True)
class BookingColumns:
    """Roles of the booking columns: categoricals are one-hot encoded, date parts
    dropped, everything else except key and target is a numeric feature."""
    categorical: tuple
    date_parts: tuple
    profile: tuple = ()  # columns drawn against the price per segment


# Target mapping and column roles of the bookings analysis
# (the hotel bookings file), and the roles in the frame derived from orders.
TARGET_MAP = {"Not_Canceled": 0, "Canceled": 1}
CSV_COLUMNS = BookingColumns(
    categorical=("type_of_meal_plan", "market_segment_type", "no_of_adults", "no_of_children",
                 "no_of_weekend_nights", "no_of_week_nights", "required_car_parking_space",
                 "no_of_special_requests", "no_of_previous_cancellations",
                 "no_of_previous_bookings_not_canceled", "repeated_guest", "room_type_reserved"),
    date_parts=("arrival_year", "arrival_month", "arrival_date"),
    profile=("no_of_adults", "no_of_children", "no_of_weekend_nights", "no_of_week_nights", "type_of_meal_plan", "lead_time",
             "market_segment_type", "booking_status"))
DERIVED_COLUMNS = BookingColumns(
    categorical=("type_of_meal_plan", "market_segment_type", "region", "no_of_items"),
    date_parts=("arrival_year", "arrival_month", "arrival_date"),
    profile=("no_of_items", "total_quantity", "region", "arrival_month", "type_of_meal_plan", "lead_time", "market_segment_type",
             "booking_status"))


def encode_bookings(bookings: DataFrame, max_levels: int = features.MAX_COLUMNS, checkpoint: bool = False,
                    cols: BookingColumns = DERIVED_COLUMNS) -> tuple[DataFrame, list[str]]:
    """Target mapped to 0/1, dates dropped, categoricals one-hot; returns (frame, feature names).

    ``checkpoint=True`` writes the mapped input once to the reliable folder, so
    level discovery, scaler moments and the fits read it instead of
    recomputing the upstream joins.
    """
    categorical = list(cols.categorical)
    df = bookings.withColumn(TARGET, map_values(TARGET, TARGET_MAP)).drop(*cols.date_parts)
    df = df.select(*[F.col(c).cast("string").alias(c) if c in categorical else F.col(c) for c in df.columns])
    if checkpoint:
        df = reliable(df, spread=True)
    enc = features.one_hot(df, categorical, max_levels=max_levels)
    feats = [c for c in enc.columns if c not in (KEY, TARGET)]
    return enc.na.fill(0, subset=feats), feats


def profile_densities(bookings: DataFrame, segment_ids: DataFrame, cols: BookingColumns = DERIVED_COLUMNS, bins: int = 32) -> DataFrame:
    """Each profile column against the price, smoothed per segment (``distributions.density_profiles``).

    ``bookings`` are the raw ones; the target is mapped to 0 and 1, categoricals to their label codes. ``segment_ids`` has
    KEY and Segment; bookings without a segment are left out.
    """
    own = list(dict.fromkeys([*cols.profile, PRICE]))
    df = bookings.select(KEY, *own)
    if TARGET in own:
        df = df.withColumn(TARGET, map_values(TARGET, TARGET_MAP))
    df = features.label_encode(df, [c for c in cols.profile if c in cols.categorical])
    # written once in columns: the densities read it for the ranges and for the counts
    df = materialise(df.join(segment_ids.select(KEY, "Segment"), KEY).drop(KEY), "profiles")
    return distributions.density_profiles(df, cols.profile, PRICE, "Segment", bins)


@dataclass
class SegmentReport:
    """Segmentation of the bookings; every part is computed when it is first asked for."""

    encoded: DataFrame           # one-hot encoded bookings (checkpointed input)
    feature_names: list          # encoded feature columns
    projected: DataFrame         # KEY, price, target, col1, col2 and the vector pc
    pca_variance: DataFrame      # component, ratio, cumulative (4 components)
    n_segments: int
    seed: int
    ks: range
    micro_clusters: int
    bookings: DataFrame          # as given
    cols: BookingColumns

    @cached_property
    def elbow(self) -> DataFrame:
        """k, distortion, is_elbow."""
        return segments.kmeans_sweep(self.projected, "pc", ks=self.ks, seed=self.seed)

    @cached_property
    def segments(self) -> DataFrame:
        """KEY, Segment, col1, col2, price, target."""
        seg = segments.hierarchical_segments(self.projected, "pc", self.n_segments, self.micro_clusters, self.seed)
        return seg.select(KEY, "Segment", "col1", "col2", PRICE, TARGET)

    @property
    def sizes(self) -> DataFrame:
        """Segment, n."""
        return self.segments.groupBy("Segment").agg(F.count(F.lit(1)).alias("n"))

    @property
    def profile(self) -> DataFrame:
        """Segment, avg_price, n."""
        return segments.segment_profile(self.segments, "Segment", PRICE, TARGET)

    @property
    def target_mix(self) -> DataFrame:
        """Segment, booking_status, n."""
        return segments.segment_target_mix(self.segments, "Segment", TARGET)

    @property
    def profiles(self) -> DataFrame:
        """column, Segment, x_bin, y_bin, x, y, density: the profile columns against the price."""
        return profile_densities(self.bookings, self.segments, self.cols)


def booking_segments(bookings: DataFrame, n_segments: int = 4, seed: int = 42, ks=range(2, 11),
                     micro_clusters: int = segments.MAX_LEAVES, cols: BookingColumns = DERIVED_COLUMNS) -> SegmentReport:
    enc, feats = encode_bookings(bookings, checkpoint=True, cols=cols)
    scaled = features.standardise(enc, feats, suffix="")
    vec = features.assemble(scaled, feats, "features").select(KEY, TARGET, PRICE, "features")
    vec = reliable(vec, spread=True)  # feeds PCA and the projection
    # one 4-component fit: its first two components are the 2-component projection
    proj, variance4 = features.pca(vec, "features", 4)
    proj = features.assemble(proj.drop("features", "col3", "col4"), ["col1", "col2"], "pc")
    return SegmentReport(enc, feats, reliable(proj, spread=True), variance4, n_segments, seed, ks, micro_clusters,
                         bookings, cols)


def cancellation_leaderboard(bookings: DataFrame, segment_ids: DataFrame | None = None,
                             test_fraction: float = 0.3, seed: int = 42, knn_k: int = 5,
                             forest_trees: int = 100, forest_depth: int = 30,
                             encoded: tuple[DataFrame, list[str]] | None = None,
                             cols: BookingColumns = DERIVED_COLUMNS, scale_features: bool = False,
                             knn_rows: int | None = None) -> DataFrame:
    """Fit logistic regression, Gaussian naive Bayes, KNN and a random forest on
    the same hold-out split and return their scores, best accuracy first.

    ``encoded`` reuses an already encoded frame (e.g. from the segmentation).
    Features are unscaled by default, as in the source analysis (D21);
    ``scale_features=True`` standardises them (population std) first. The neighbours vote among all
    training rows; ``knn_rows`` fits on so many of them."""
    enc, feats = encoded if encoded is not None else encode_bookings(bookings, cols=cols)
    if scale_features:
        enc = features.standardise(enc, feats)
    if segment_ids is not None:
        enc = enc.join(segment_ids.select(KEY, F.col("Segment").cast("double").alias("Segment")), KEY)
        feats = feats + ["Segment"]
    # written, as finding the ranges of the row index and making them each read it
    prepared = materialise(features.assemble(enc, feats, "features").select(KEY, TARGET, "features"), "prepared")
    # numeric row id for the neighbour search: the place in the order of the keys, so ties fall alike in every run
    data = (scan.row_index(prepared, KEY, "_rid")
            .select(KEY, "_rid",
                    F.col(TARGET).cast("double").alias("label"), "features",
                    features.split_flag(KEY, test_fraction, seed).alias("_split")))
    data = reliable(data, spread=True)  # one prepared matrix for four fits
    train = data.where(F.col("_split") == "train")
    test = data.where(F.col("_split") == "test")
    n_train = train.count()

    tr = train.select("_rid", "label", vector_to_array("features").alias("vec"))
    te = test.select("_rid", "label", vector_to_array("features").alias("vec"))
    fits = {
        "Logistic regression": lambda: classify.fit_logistic(train, n_rows=n_train).transform(test),
        "Naive Bayes": lambda: classify.fit_naive_bayes(train).transform(test),
        "KNN": lambda: classify.knn_predict(tr, te, knn_k, id_col="_rid", vec_col="vec", label_col="label",
                                            fit_rows=knn_rows),
        "Random forest": lambda: classify.fit_forest(train, trees=forest_trees, max_depth=forest_depth,
                                                     seed=seed).transform(test),
    }
    # independent fits: submitted together, Spark interleaves their jobs
    with ThreadPoolExecutor(max_workers=len(fits)) as pool:
        futures = {name: pool.submit(fn) for name, fn in fits.items()}
        scored = [(name, f.result()) for name, f in futures.items()]
    results = [classify.binary_metrics(p, "label", "prediction", positive=1.0, model=name)
               for name, p in scored]
    return classify.leaderboard(results, by="accuracy")
