"""DataFrame transformations over long tables of points, boxes and components."""
