"""platter: a PySpark-native analytics engine for orders, menus and reviews."""
