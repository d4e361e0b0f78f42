"""The feature views that come with the library."""

from __future__ import annotations

from tidemark.sources.store import FeatureStore, FeatureView, with_source

# View names, entities, feature types and times to live in days.
HOURLY_LOAD = FeatureView("etth1_features", ("location",), {
    "HUFL": "float",
    "MUFL": "float",
    "HUFL_lag24": "float",
    "MUFL_lag24": "float",
    "HUFL_roll12_mean": "float",
    "MUFL_roll12_mean": "float",
    "hour_sin": "float",
    "hour_cos": "float",
    "dow_sin": "float",
    "dow_cos": "float",
    "mobility_inflow": "float",
}, ttl_days=365)

FORECAST = FeatureView("forecast_view", ("location",), {
    "temperature": "float",
    "demand": "float",
    "temperature_lag24": "float",
    "demand_roll12_mean": "float",
}, ttl_days=7)

FRAUD = FeatureView("fraud_view", ("user",), {
    "amount": "float",
    "tx_count_30m": "float",
    "risk_score": "float",
}, ttl_days=30)

RECOMMENDATION = FeatureView("recsys_view", ("recsys_user",), {
    "view_count": "float",
    "like_ratio": "float",
    "item_id": "int",
}, ttl_days=2)

STATION = FeatureView("station_stats", ("station",), {"production": "float"}, ttl_days=1)

PASSENGER = FeatureView("titanic_view", ("passenger",), {
    "Pclass": "int",
    "Age": "float",
    "SibSp": "int",
    "Parch": "int",
    "Fare": "float",
    "Sex": "string",
    "Embarked": "string",
    "Survived": "int",
})

VIEWS = (HOURLY_LOAD, FORECAST, FRAUD, RECOMMENDATION, STATION, PASSENGER)


def register(store: FeatureStore, view: FeatureView, key: str, source: str) -> FeatureView:
    """Declare a shipped view, with its integer entity, over a source."""
    if not key or not source:
        raise ValueError("key and source must not be empty")
    store.register_entity(view.entities[0], key, "int")
    return store.register_view(with_source(view, source))
