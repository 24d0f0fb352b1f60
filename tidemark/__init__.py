"""Analytics over file manifests and synchronisation history, as Spark jobs."""
