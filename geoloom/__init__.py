"""Spatial and corpus analytics on PySpark."""

__version__ = "0.1.0"

_API = ("AsyncDatasetHandle", "Dataset", "MVTResult", "TileResult", "add_dataset", "add_dataset_async", "build", "create_app", "delete_dataset", "estimate_range_count", "export_pmtiles", "generate_mvt", "generate_single_mvt_tile", "get_dataset_metadata", "get_dataset_summary", "get_sample_record", "get_temp_dir", "get_tile", "list_datasets", "query_dataset", "query_dataset_count", "query_dataset_size", "query_frame", "search_datasets", "set_temp_dir", "tile")


def __getattr__(name: str):
    # Workers import this package too; what the driver alone needs is loaded when asked for.
    if name in _API:
        from geoloom import api

        return getattr(api, name)
    raise AttributeError(name)
