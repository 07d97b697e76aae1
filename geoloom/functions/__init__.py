"""Part of geoloom; see the README for the layout."""
